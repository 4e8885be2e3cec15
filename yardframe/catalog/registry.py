"""All registered queries."""

from yardframe.catalog import analyses, fitted, relational, statistics  # noqa: F401
from yardframe.catalog.base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
