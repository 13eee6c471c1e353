"""Named queries over the test tables, each with its SQL twin."""

from . import decisions, events, evidence, files, goods, matching, notices, offers, quotes, registers, relational, texts, trackers  # noqa: F401
from . import parts  # noqa: F401, I001  of queries that the others register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
