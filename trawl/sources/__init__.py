"""Readers: catalog tables, directory trees, file contents."""
