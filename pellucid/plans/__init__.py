"""Registered queries, each with the SQL that checks it."""

from pellucid.plans import batch, calls, dialogue, pictures, runs, tiled
from pellucid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "batch", "calls", "dialogue", "pictures", "runs", "tiled"]
