"""The queries of the engine over the tables of a data folder, and their SQL."""

from jobloom.plans import catalog_queries, change_queries, content_queries, feed_queries, page_queries, review_queries, scan_queries
from jobloom.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "change_queries", "content_queries", "feed_queries", "page_queries", "review_queries", "scan_queries"]
