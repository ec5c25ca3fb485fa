"""All queries over the reference tables and their DuckDB forms."""

from __future__ import annotations

from covary.plans import batteries, desk, forests, merged, more, relational, research, scalar, streams, systems, trading  # noqa: F401
from covary.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
