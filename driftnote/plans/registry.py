"""The modules whose QUERIES and ORACLE are registered."""

from __future__ import annotations

from . import evidence_queries, field_queries, insight_queries, orphan_queries, ranking_queries, relation_queries, stream_queries, term_queries, text_queries

FLAGSHIP = "lif4_spikes"


def modules() -> list:
    return [orphan_queries, text_queries, evidence_queries, field_queries, relation_queries, stream_queries, insight_queries, ranking_queries, term_queries]
