"""Change-event normalisation and micro-batch application."""
