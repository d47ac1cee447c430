"""Queries over the driver's tables, by name, with SQL that must give the same rows."""

from . import courses, events, grading, metrics, nested, pairs, programs, relational, rules, summaries, text, vectors, whole
from .registry import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "courses", "events", "grading", "metrics", "nested", "pairs", "programs", "relational", "rules", "summaries", "text", "vectors", "whole"
]
