"""The files that the diffused vectors are written in: one for each block of features, however few splits the blocks' own table has."""

import datetime

import numpy as np
import pyarrow.parquet as pq

from driftnote.operators import diffusion as D
from driftnote.plans import field_queries as Q

SCHEMA = "obs_id long, rel_path string, day date, title string, text string, tags array<string>, links array<string>"


def test_no_file_holds_much_of_the_result(spark, tmp_path):
    rows = [(k, f"f{k}/n.md", datetime.date(2025, 12, 1), f"t{k}", " ".join(f"w{k}x{i}" for i in range(150)), ["x"], [f"t{k % 7}"]) for k in range(1, 101)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "note_observations.parquet"))
    result = Q.lif14_diffused_vectors(spark, str(tmp_path))
    result.write.parquet(str(tmp_path / "out"))
    sizes = [pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "out").glob("*.parquet")]
    assert sum(sizes) >= 15_000
    assert max(sizes) < sum(sizes) / 16  # 32 blocks over 8 cores; a file for each core would hold an eighth


def test_a_hot_feature_added_up_unsorted_has_the_same_weights():
    pick = np.random.default_rng(3)
    src, dst = np.divmod(np.unique(pick.integers(0, 50 * 50, 300)), 50)
    order = np.argsort(dst, kind="stable")
    g = D.Graph(np.arange(50), np.concatenate(([0], np.cumsum(np.bincount(dst, minlength=50)))), src[order].astype(np.int32))
    key = np.flatnonzero(pick.random(20 * 50) < np.repeat(pick.random(20), 50))
    weight = pick.random(len(key))
    sorted_, unsorted = ([np.concatenate(x) for x in zip(*D._joined(g, key, weight, piece), strict=True)] for piece in (10**6, 1))
    assert (sorted_[0] == unsorted[0]).all()
    assert np.allclose(sorted_[1:], unsorted[1:], rtol=0, atol=1e-12)
