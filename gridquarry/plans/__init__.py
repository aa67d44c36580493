"""The registered queries over driver tables, with oracles."""

from gridquarry.plans import geometry, rasters, runs, stores
from gridquarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "geometry", "rasters", "runs", "stores"]
