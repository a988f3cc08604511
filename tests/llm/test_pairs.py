from collections import Counter
from datetime import date
from itertools import combinations
from random import Random

from driftnote.llm.pair_table import PairTable, emitted_pairs

SCHEMA = "id long, day date, terms array<string>"


def brute(rows):
    last = {i: (d, t) for i, d, t in rows}
    pairs, days, n = Counter(), {}, Counter()
    for d, t in last.values():
        terms = sorted({x.strip().lower() for x in (t or []) if x and x.strip()})
        n.update(terms)
        for p in combinations(terms, 2):
            pairs[p] += 1
            days.setdefault(p, set()).add(d)
    return {p: (c, len(days[p]), n[p[0]], n[p[1]], len(last)) for p, c in pairs.items()}


def scores(table):
    return {(r["term_a"], r["term_b"]): (r["count"], r["distinct_days"], r["n_a"], r["n_b"], r["n_records"]) for r in table.scores().collect()}


def test_increments_are_the_whole(spark, tmp_path):
    r = Random(3)
    make = lambda i: (i, date(2024, 1, 1 + r.randrange(20)), r.choice([None, [], [r.choice("ABcdEfgh ") for _ in range(r.randrange(6))] + [None, ""]]))
    first, second = [make(i) for i in range(60)], [make(i) for i in range(30, 90)]
    table = PairTable(spark, str(tmp_path / "t"), rows_a_bucket=10, least_buckets=4)
    table.apply(spark.createDataFrame(first, SCHEMA), "id", "day", "terms")
    assert scores(table) == brute(first)
    again = PairTable(spark, str(tmp_path / "t"), rows_a_bucket=10, least_buckets=4)  # read from the folder
    again.apply(spark.createDataFrame(second, SCHEMA), "id", "day", "terms")
    assert scores(again) == brute(first + second)
    again.apply(spark.createDataFrame(second, SCHEMA), "id", "day", "terms")  # nothing new
    assert scores(again) == brute(first + second)
    gone = [(i, d, []) for i, d, _ in second]
    again.apply(spark.createDataFrame(gone, SCHEMA), "id", "day", "terms")
    assert scores(again) == brute(first + second + gone)


def test_edges(spark, tmp_path):
    table = PairTable(spark, str(tmp_path / "e"), least_buckets=2)
    table.apply(spark.createDataFrame([], SCHEMA), "id", "day", "terms")
    assert table.scores().count() == 0
    rows = [(1, None, ["a", "b"], "x"), (1, None, ["a", "b"], "x"), (None, date(2024, 1, 1), ["a", "b"], "y"), (None, None, ["b", "c"], "z")]
    table.apply(spark.createDataFrame(rows, SCHEMA + ", count string"), "id", "day", "terms")
    assert scores(table) == {("a", "b"): (2, 1, 2, 3, 3), ("b", "c"): (1, 0, 3, 1, 3)}


def test_wide_basket(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), [f"t{i:03}" for i in range(200)])], "sign long, day date, terms array<string>")
    out = emitted_pairs(df, wide=16)
    assert out.count() == 200 * 199 // 2 and out.where("term_a >= term_b").count() == 0


def test_a_break_loses_nothing(spark, tmp_path, monkeypatch):
    first = [(i, date(2024, 1, 1 + i % 5), ["a", f"t{i % 7}"]) for i in range(20)]
    second = [(i, date(2024, 1, 1 + i % 5), ["a", "b"]) for i in range(15, 25)]
    table = PairTable(spark, str(tmp_path / "b"))
    table.apply(spark.createDataFrame(first, SCHEMA), "id", "day", "terms")

    def dies(state):
        raise OSError("gone before the manifest got its name")

    monkeypatch.setattr(table, "_commit", dies)
    try:
        table.apply(spark.createDataFrame(second, SCHEMA), "id", "day", "terms")
    except OSError:
        pass
    assert scores(table) == brute(first) == scores(PairTable(spark, str(tmp_path / "b")))
    monkeypatch.undo()
    table.apply(spark.createDataFrame(second, SCHEMA), "id", "day", "terms")  # once more, on the same object
    assert scores(table) == brute(first + second) == scores(PairTable(spark, str(tmp_path / "b")))
    files = [p for p in (tmp_path / "b").rglob("*.parquet")]
    table.apply(spark.createDataFrame(first[:1], SCHEMA), "id", "day", "terms")
    assert len([p for p in (tmp_path / "b").rglob("manifest-*.json")]) == 2 and len([p for p in (tmp_path / "b").rglob("*.parquet")]) <= 2 * len(files)


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    r = Random(4)
    rows = [(i, date(2024, 1, 1), [f"t{r.randrange(400)}" for _ in range(4)]) for i in range(800)]
    table = PairTable(spark, str(tmp_path / "s"), rows_a_bucket=20)
    table.apply(spark.createDataFrame(rows, SCHEMA), "id", "day", "terms")
    assert table.state["buckets"]["pairs"] >= 128
    table.apply(spark.createDataFrame([(5, date(2024, 1, 1), ["t1", "t2"])], SCHEMA), "id", "day", "terms")
    assert len(table.last["baskets"]) == 1 and len(table.last["pairs"]) <= 7 and table.last["totals"] == table.last["pairs"] and len(table.last["marginals"]) <= 6
    assert scores(table) == brute(rows + [(5, date(2024, 1, 1), ["t1", "t2"])])
