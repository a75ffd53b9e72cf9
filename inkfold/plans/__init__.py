"""Queries of the engine; ``QUERIES`` and ``ORACLE`` are complete once this is imported."""

from inkfold.plans import attributes, corpus, extra, parsing, relational, vectors  # noqa: F401
from inkfold.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
