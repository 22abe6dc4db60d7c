"""The search box language: tokens, term patterns, filters. Runs on the driver only."""

from trawl.query.errors import BadDate, BadRegex, QueryError, UnknownProperty, UnsupportedOp
from trawl.query.lexer import LexError, Token, tokenize, tokenize_spanned
from trawl.query.pattern import Pattern, Regex
from trawl.query.split import Query, parse

__all__ = [
    "BadDate", "BadRegex", "LexError", "Pattern", "Query", "QueryError", "Regex", "Token", "UnknownProperty",
    "UnsupportedOp", "parse", "tokenize", "tokenize_spanned",
]
