from datetime import date

import pytest

from driftnote.operators.orphans import orphan_references

D = date(2024, 5, 1)


def test_masks_and_semantics(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "x string, y int")
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", None), (4, "z", None), (5, None, 2), (6, None, 9), (7, None, None), (8, "c", None), (2, "a", 2)], "id int, x string, y int")
    got = lambda m: sorted(r["id"] for r in orphan_references(refs, parents, ["x", "y"], match=m).collect())
    assert got("simple") == [2, 2]
    assert got("partial") == [2, 2, 4, 6]
    assert got("full") == [2, 2, 3, 4, 5, 6, 8]
    with pytest.raises(ValueError):
        orphan_references(refs, parents, ["x"], match="none")


def test_times(spark):
    parents = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 5, 1)), ("a", date(2024, 6, 1), None), ("b", None, None)], "k string, s date, u date")
    refs = spark.createDataFrame([(1, "a", date(2024, 4, 30)), (2, "a", D), (3, "a", date(2024, 6, 1)), (4, "b", D), (5, "a", None), (6, "q", None), (7, "a", date(2023, 1, 1))], "id int, k string, d date")
    got = orphan_references(refs, parents, ["k"], match="partial", at="d", since="s", until="u")
    assert sorted(r["id"] for r in got.collect()) == [2, 6, 7]


def test_empty_and_clashing(spark):
    schema = "k string, salt string, mask string, row string, t string, o_k0 string"
    refs = spark.createDataFrame([("a", "1", "2", "3", "4", "5"), ("b", "1", "2", "3", "4", "5")], schema)
    none = spark.createDataFrame([], "k string")
    assert orphan_references(refs, none, ["k"]).count() == 2
    assert orphan_references(refs.limit(0), none, ["k"]).count() == 0
    got = orphan_references(refs, spark.createDataFrame([("a",)], "k string"), ["k"])
    assert got.columns == refs.columns and [r["k"] for r in got.collect()] == ["b"]


def test_hot_key(spark):
    refs = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as k")
    parents = spark.range(3000).where("id % 2 = 0").selectExpr("cast(id as string) as k")
    want = 1000 + sum(1 for i in range(3000) if i % 3 and i % 2)
    assert orphan_references(refs, parents, ["k"]).count() == want
    assert orphan_references(refs, parents, ["k"], rows_a_salt=100).count() == want  # the hot key over ten salts
