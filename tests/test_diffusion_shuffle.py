"""What the diffused field shuffles: nothing that grows with the length of the texts, and names compressed."""

import datetime
import random

import pytest

from driftnote.plans import field_queries as Q

SCHEMA = "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>"
NOTES, LENGTH = 40, 20_000


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(int(x.totalShuffleWrite()) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)))


def _during(spark, name, folder):
    before = _shuffled(spark)
    rows = Q.QUERIES[name](spark, folder).collect()
    return rows, _shuffled(spark) - before


@pytest.mark.parametrize("name", ["lif10_diffused_calendar", "agg17_diffused_energy"])
def test_no_text_is_shuffled(spark, tmp_path, name):
    pick = random.Random(7)
    rows = [(k, f"f{k}/n.md", datetime.date(2025, 12, 1), f"t{k}", "drift " + "".join(chr(pick.randrange(0x10A0, 0x1400)) for _ in range(LENGTH)), [], ["t1"]) for k in range(1, NOTES + 1)]  # letters that are no features
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    got, shuffled = _during(spark, name, str(tmp_path))
    assert len(got) == 1
    assert shuffled < NOTES * LENGTH / 4  # a text takes over a byte a letter, whatever compresses it


def test_names_are_shuffled_compressed(spark, tmp_path):
    rows = [(k, f"f{k}/n.md", datetime.date(2025, 12, 1), f"t{k}", " ".join(f"word{k}x{i}" for i in range(2_000)), [], []) for k in range(1, 11)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    got, shuffled = _during(spark, "lif14_diffused_vectors", str(tmp_path))
    words = [r for r in got if r["feature"].startswith("word")]
    assert len({(r["note_id"], r["feature"]) for r in words}) == 20_000
    assert shuffled < 700_000  # loose names took 0.96 MB
