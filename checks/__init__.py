"""Queries over the given tables, each with the DuckDB SQL that must give the same rows."""

from . import analysis, auditing, discovery, profiling
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "auditing", "discovery", "profiling"]
