"""Queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from .plans import answers, conversations, courses, evaluation, kmaps, prices, retrieval, sections, sources, streams, structure, tables, text, traces  # noqa: F401
from .registration import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
