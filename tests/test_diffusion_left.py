"""What the diffused field leaves in the local folders while it runs: no shuffle files and no copies of the graph, once they have been read."""

import datetime
from pathlib import Path

import pytest

from driftnote.plans import field_queries as Q

SCHEMA = "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>"


def _local(spark):
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(p.stat().st_size for d in [*dirs, spark.sparkContext._temp_dir] for p in Path(d).rglob("*") if p.is_file())


@pytest.mark.parametrize("query, least", [(Q._diffused_hits, 200), (Q.lif14_diffused_vectors, 30_000)])
def test_nothing_stays_of_the_rounds(spark, tmp_path, query, least):
    rows = [(k, f"f{k}/n.md", datetime.date(2025, 12, 1), f"t{k}", " ".join(f"w{k}x{i * k}" for i in range(150)) + " drift", ["x"], [f"t{k % 7}"]) for k in range(1, 201)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    before = _local(spark)
    rows = query(spark, str(tmp_path))
    assert _local(spark) - before < 30_000
    assert rows.count() >= least
