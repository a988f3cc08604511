import importlib

import pytest
from oracle import DATA, same

from driftnote.llm import registry

QUERIES = {n: q for m in registry.modules() for n, q in m.QUERIES.items()}
ORACLE = {n: s for m in registry.modules() for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", ["p2_groups", "p4_redacted", "p6_fill", "p7_by_item"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_found_columns(spark):
    want = {
        "p1_found": ["term_a", "term_b"], "p2_found": ["id_a", "id_b"], "p4_found": ["source_table", "source_id", "kind", "occurrence"], "p5_found": ["field_name", "term", "mark"],
        "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "segment_no", "lang"],
    }
    assert importlib.import_module("__spark_entry__")
    for name, columns in want.items():
        if name != "p2_found":
            assert QUERIES[name](spark, DATA).columns == columns
