"""Queries over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from . import aggregates, formats, recordings, scoring, shapes, spans, windows
from .registry import QUERIES, SQL

__all__ = ["aggregates", "formats", "queries", "recordings", "scoring", "shapes", "spans", "sql", "windows"]


def queries():
    return QUERIES


def sql():
    return SQL
