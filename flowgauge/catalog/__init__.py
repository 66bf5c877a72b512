"""Registered queries over the driver's tables, each with its SQL counterpart."""

from flowgauge.catalog import data, measures, models, partitions, reports, streams  # noqa: F401
from flowgauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
