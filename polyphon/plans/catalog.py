"""All registered queries; importing this module fills the catalogue."""

from polyphon.plans import metric_queries, replacement_queries, stream_queries, training_queries, tree_queries, version_queries, vote_queries  # noqa: F401
from polyphon.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
