"""Named queries over the star-schema tables, each with its SQL oracle."""

from shelfcast.catalog import basket, credit, explore, features, hierarchy, models, scans, sketches, trees  # noqa: F401
from shelfcast.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
