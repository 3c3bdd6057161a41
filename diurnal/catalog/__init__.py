"""Named queries over the test tables, each with equivalent SQL where SQL can express it."""

from . import files, geometry, grouping, joining, measures, models, strings, tables  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
