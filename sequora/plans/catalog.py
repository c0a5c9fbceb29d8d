"""All queries by name, and their SQL."""

from . import classification, concept_queries, relational, report_queries, signal_queries, site_queries, tree_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "knn_orbit"
