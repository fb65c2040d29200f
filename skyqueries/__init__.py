"""Registered queries over the driver tables, each with its SQL counterpart where SQL can express it."""

from skyqueries import correlating, covering, mapping, matching, pixels, region_rows, searching  # noqa: F401
from skyqueries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
