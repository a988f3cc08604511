"""The modules whose QUERIES and ORACLE are registered."""

from __future__ import annotations

from . import frequency_queries, language_queries, leakage_queries, neardup_queries, packing_queries, pair_queries, pii_queries


def modules() -> list:
    return [pair_queries, neardup_queries, pii_queries, frequency_queries, packing_queries, leakage_queries, language_queries]
