"""All queries on sequencing records; importing the modules registers them."""

from __future__ import annotations

from readloom.plans import alignments, indexes, records  # noqa: F401
from readloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
