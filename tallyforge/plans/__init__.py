"""Whole plans: registered queries and end-to-end scoring."""

from . import evaluation, further, literal, relational
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "literal", "relational"]
