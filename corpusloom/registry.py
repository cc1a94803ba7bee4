"""Queries of the engine's own operators and their DuckDB SQL, by name."""

from __future__ import annotations

from .plans.oracles import SQL
from .plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
