"""All queries over the catalog tables, each with its oracle."""

from . import aggregates, composites, filters, joins, metrics, names, ordered, scalars, scans, vectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
