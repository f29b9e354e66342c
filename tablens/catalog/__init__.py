"""Named queries over the driver tables, and the SQL they are checked against."""

from . import association, charts, sampling, sources, summary, tasks, text, typing
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
