"""Frequency of every distinct term: occurrences, records, and marks for the too rare and the too common.

Last-seen counters. Records are hash-partitioned by their id and read in order of id, so that
all arrivals of one record stand together and only the first (the latest arrival) counts. Within a
partition every term has three numbers: occurrences, records, and the last record that held it; a
token raises the record count only if its record is not the last one seen, so no set of records is
kept. The partial counts of the partitions are then added by term.

Scale: each term leaves a partition once (or once a flush of the bounded counter table), so the hottest
term costs one row a partition in the second shuffle. Counts are exact; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import keyed_rows, term_key
from ..session import cut

FLUSH = 400_000


def _counters(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    # one record's arrivals may stand in two batches, so the last id is kept between them
    last_id = None
    seen: dict[str, list[int]] = {}
    records = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "term": pa.array(list(seen) + [None], pa.string()),
                "occurrences": pa.array([v[0] for v in seen.values()] + [0], pa.int64()),
                "records": pa.array([v[1] for v in seen.values()] + [records], pa.int64()),
            }
        )

    number = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (values[1:] != values[:-1]) | null[1:] | null[:-1]
        new[0] = null[0] or last_id is None or values[0] != last_id
        last_id = None if null[-1] else values[-1]
        records += int(new.sum())
        rows, codes, keys = keyed_rows(batch.column(1), term_key)
        ok = new[rows]
        rows, codes = rows[ok], codes[ok]
        # two spellings of one key share a counter
        counters = [seen.setdefault(k, [0, 0, -1]) if k is not None else None for k in keys]
        for code, record in zip(codes.tolist(), (rows + number).tolist()):
            counter = counters[code]
            counter[0] += 1
            if counter[2] != record:  # the last record that held it is another one
                counter[1] += 1
                counter[2] = record
        number += n
        if len(seen) >= flush:  # records don't span batches' ends: later arrivals of one are passed over
            yield out()
            seen, records = {}, 0
    yield out()


def term_frequencies(df: DataFrame, id_column: str, terms: str, arrived: str | None = None, rare_below: int = 3, common_one_in: int = 20, flush: int = FLUSH) -> DataFrame:
    """term, occurrences, records, n_records and mark of every term key in the array column ``terms``.

    mark is ``rare`` where fewer than ``rare_below`` records hold the term, else ``common`` where at least one
    record in ``common_one_in`` does, else null. Each id counts once (its latest ``arrived``, if given); n_records counts
    all ids, also those with null or empty arrays. Rows with a null id count one by one. Null, blank and
    empty terms are none; an empty table gives no rows; other columns are not read.
    """
    order = [F.col("id").asc_nulls_first()] + ([F.col("arrived").desc_nulls_last()] if arrived else [])
    rows = df.select(F.col(id_column).alias("id"), F.col(terms).alias("terms"), *([F.col(arrived).alias("arrived")] if arrived else []))
    # null ids carry no key to share, so they are spread
    spread = F.when(F.col("id").isNull(), F.xxhash64("terms")).otherwise(F.xxhash64("id"))
    rows = rows.repartition(spread).sortWithinPartitions(*order).select("id", "terms")
    # written once: the records' number and the terms' counts both read it
    partial = cut(rows.mapInArrow(lambda it: _counters(it, flush), "term string, occurrences bigint, records bigint"), "counters")
    named = partial.where("term is not null").groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # the null term counts all records: a single number
    total = partial.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    named = named.withColumn("n_records", F.lit(total).cast("bigint"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_one_in >= F.col("n_records"), "common")
    return named.withColumn("mark", mark)
