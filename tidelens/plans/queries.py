"""All registered queries."""

from . import files, relational, statistics, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "relational", "statistics", "texts"]
