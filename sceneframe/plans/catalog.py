"""The query catalogue: importing this module registers every query."""

from sceneframe.plans import catalog_codes, catalog_media, catalog_scenes  # noqa: F401
from sceneframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
