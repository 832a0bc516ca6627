"""All registered queries; importing the modules fills the registry."""

from winnow.plans import curation, curriculum, evaluation, sources_queries  # noqa: F401
from winnow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
