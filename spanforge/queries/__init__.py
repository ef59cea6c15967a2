"""Fixture queries of the library and their SQL counterparts."""

from spanforge.queries import checking, composed, ingesting, joining, spanning, summaries, tagging, texts, zoning
from spanforge.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checking", "composed", "ingesting", "joining", "spanning", "summaries", "tagging", "texts", "zoning"]
