from collections import Counter

from driftnote.llm.frequency import term_frequencies


def test_against_brute_force(spark):
    rows = [(i, [f"t{i % 7}", "Hot", "hot", None, " "] if i % 11 else None, i % 5) for i in range(500)] + [(3, ["t3", "Hot", "hot", None, " "], 99), (None, ["n"], 1), (None, ["n"], 1), (900, [], 1)]
    df = spark.createDataFrame(rows, "id long, terms array<string>, arrived int").withColumnRenamed("arrived", "records")
    for flush in (3, 400_000):
        got = {r["term"]: r for r in term_frequencies(df, "id", "terms", "records", flush=flush).collect()}
        occ, rec = Counter(), Counter()
        for _, terms, _ in rows[:500] + rows[501:]:
            keys = [t.lower() for t in terms or [] if t and t.strip()]
            occ.update(keys), rec.update(set(keys))
        assert {t: (r["occurrences"], r["records"]) for t, r in got.items()} == {t: (occ[t], rec[t]) for t in occ}
        assert got["hot"]["mark"] == "common" and got["n"]["mark"] == "rare" and got["n"]["n_records"] == 503


def test_empty(spark):
    assert term_frequencies(spark.createDataFrame([], "id long, terms array<string>"), "id", "terms").count() == 0
