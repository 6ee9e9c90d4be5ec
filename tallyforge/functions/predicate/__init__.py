"""The predicate language: integer clauses over program states."""

from .canonical import dedup_key, dedup_normalized, key_text
from .check import Scope, check, syntax_filter
from .evaluate import evaluate, first_falsifying, to_column
from .syntax import ParseError, bind_constants, normalize, parse

__all__ = ["ParseError", "Scope", "bind_constants", "check", "dedup_key", "dedup_normalized", "evaluate", "first_falsifying", "key_text", "normalize", "parse", "syntax_filter", "to_column"]
