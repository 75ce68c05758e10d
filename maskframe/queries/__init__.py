"""Every operator as a query over the given tables, with SQL to check it against."""

from . import checks, feeds, figures, fleet, scans, snapshots  # noqa: F401  (registers the queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
