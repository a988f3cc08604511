"""Items that appear together: a pair table that is kept up to date by signed deltas.

The table lives in a folder that all executors share, in hash buckets:

* ``baskets``  (id, day, terms): the last known state of every basket, by hash of its id
* ``pairs``    (term_a, term_b, day, count): by hash of the pair
* ``totals``   (term_a, term_b, count, distinct_days): by hash of the pair
* ``marginals`` (term, n): by hash of the term

``apply`` takes a batch of baskets. A basket that is new or differs from its last known state emits +1 for
each pair and term it now has and -1 for each it had; equal ones emit nothing. The deltas are added up before
they are shuffled, and merged into the buckets they touch; other buckets are neither read nor written. Then the totals of the
affected pairs, those with a delta, are made anew within the same buckets. The terms' own counts and the number of
records change the association of every pair that a term is in, so they are kept apart and brought in when scores are read.

Scale: a basket's pairs are made by two nested explodes, row by row (never as one array), and a wide basket is
spread over the cluster between the two, so no task holds an unbounded group. A pair or term in a third of all
baskets is added up before the shuffle. The number of buckets follows the rows, ``ROWS_A_BUCKET`` of them each, and is doubled as the table grows. Of the terms' counts,
those of one record in ``SHARE`` or more (at most that many times the mean size of a basket) are sent to the pairs, which so aren't gathered by a hot term.

Durability: a version's files are complete before its numbered manifest names them, and the manifest is complete before it gets its name. The greatest manifest counts; a run that breaks off leaves
the last version as it was, in the folder and in the object. Files that neither of the last two versions names are deleted.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import term_keys
from ..session import cut, discard, file_system

WIDE = 64
ROWS_A_BUCKET = 500_000
LEAST_BUCKETS = 8
SHARE = 1000
_PARTS = {
    "baskets": "id string, day date, terms array<string>",
    "pairs": "term_a string, term_b string, day date, count bigint",
    "totals": "term_a string, term_b string, count bigint, distinct_days bigint",
    "marginals": "term string, n bigint",
}
_KEYS = {"baskets": ["id"], "pairs": ["term_a", "term_b"], "totals": ["term_a", "term_b"], "marginals": ["term"]}


def emitted_pairs(baskets: DataFrame, wide: int = WIDE) -> DataFrame:
    """term_a < term_b of every basket in (sign, day, terms), terms being distinct and in order."""
    heads = lambda rows: rows.select("sign", "day", F.posexplode("terms").alias("at", "term_a"), "terms")
    narrow = heads(baskets.where(F.size("terms").between(2, wide)))
    broad = heads(baskets.where(F.size("terms") > wide)).repartition(F.xxhash64("terms", "at"))
    tails = lambda rows: rows.select("sign", "day", "term_a", F.explode(F.expr("slice(terms, at + 2, size(terms))")).alias("term_b"))
    return tails(narrow).unionAll(tails(broad))


class PairTable:
    """The pair table in the folder ``path``; a new folder starts empty."""

    def __init__(self, spark: SparkSession, path: str, rows_a_bucket: int = ROWS_A_BUCKET, least_buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.rows_a_bucket, self.least_buckets = spark, path.rstrip("/"), rows_a_bucket, least_buckets
        self._fs, _ = file_system(spark, self.path)
        self.state = self._read_manifest() or {"version": 0, "records": 0, "rows": dict.fromkeys(_PARTS, 0), "buckets": dict.fromkeys(_PARTS, 0), "files": {p: {} for p in _PARTS}}
        #: of the last batch: changed baskets, and the buckets of each part that were read and written
        self.last: dict = {}

    # -- storage

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifests(self) -> list[str]:
        """Names of the complete manifests, the newest first."""
        if not self._fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        return sorted((n for n in names if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(self._at(name).toString(), wholetext=True).first()[0])

    def _read_manifest(self) -> dict | None:
        names = self._manifests()
        return self._load(names[0]) if names else None

    def _commit(self, state: dict) -> None:
        """Make ``state`` the version that counts: its manifest is written under another name and then gets its own, which no earlier one has."""
        state["version"] += 1
        tmp, at = self._at(f"writing-{uuid.uuid4().hex}"), self._at(f"manifest-{state['version']:012d}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(tmp, at):
            raise RuntimeError(f"version {state['version']} of {self.path} was written by another run")
        self.state = state

    def _sweep(self) -> None:
        """Delete manifests but the last two, and files that neither names."""
        names = self._manifests()
        for n in names[2:]:
            self._fs.delete(self._at(n), False)
        named = {f for n in names[:2] for part in self._load(n)["files"].values() for f in part.values()}
        for part in _PARTS:
            if self._fs.exists(self._at(part)):
                for run in self._fs.listStatus(self._at(part)):
                    own = f"{part}/{run.getPath().getName()}"
                    held = [x.getPath().getName() for x in self._fs.listStatus(run.getPath())]
                    unnamed = [b for b in held if f"{own}/{b}" not in named]
                    for b in [""] if len(unnamed) == len(held) else unnamed:
                        self._fs.delete(self._at(f"{own}/{b}".rstrip("/")), True)

    def _bucket(self, part: str, state: dict):
        return F.pmod(F.xxhash64(*_KEYS[part]), F.lit(state["buckets"][part])).cast("int")

    def _stored(self, part: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        files = state["files"][part]
        paths = [f"{self.path}/{files[b]}" for b in (files if buckets is None else map(str, buckets)) if b in files]
        return self.spark.read.schema(_PARTS[part]).parquet(*paths) if paths else self.spark.createDataFrame([], _PARTS[part])

    def _replace(self, part: str, rows: DataFrame, state: dict, buckets: list[int]) -> None:
        """Write the given buckets of a part anew; one row of bookkeeping for each bucket comes to the driver."""
        into = f"{part}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(part, state)).repartition(max(1, len(buckets)), "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{into}")
        made = {x.getPath().getName() for x in self._fs.listStatus(self._at(into))}
        for b in buckets:
            if f"bucket={b}" in made:
                state["files"][part][str(b)] = f"{into}/bucket={b}"
            else:
                state["files"][part].pop(str(b), None)

    def _merge(self, part: str, delta: DataFrame, merged, state: dict, more: int) -> list[int]:
        """Put ``merged(stored rows)`` in the place of the buckets that ``delta`` touches, of all of them where ``more`` rows at most make the part outgrow its buckets.
        Gives the buckets that were read."""
        state["rows"][part] += more
        buckets = state["buckets"][part]
        if state["rows"][part] > 2 * buckets * self.rows_a_bucket or not buckets:
            wanted = max(self.least_buckets, -(-state["rows"][part] // self.rows_a_bucket))
            before = self._stored(part, state) if buckets else self._stored(part, state, [])
            state["buckets"][part], state["files"][part] = 1 << (wanted - 1).bit_length(), {}
            touched = list(range(state["buckets"][part]))
        else:
            touched = sorted(r[0] for r in delta.select(self._bucket(part, state)).distinct().collect())  # as many as there are buckets at most
            before = self._stored(part, state, touched)
        if touched:
            self._replace(part, merged(before), state, touched)
        return touched

    # -- the operator

    def apply(self, batch: DataFrame, id_column: str, day: str, terms: str) -> None:
        """Take in a batch of new and changed baskets.

        Rows of one id are arrivals of one basket: the greatest (day, terms) counts, each id once. A null id is a basket for each
        row. Terms are term keys, once a basket; null, empty and blank ones are none. A null day counts for no day. An empty batch changes nothing.
        """
        state, first = copy.deepcopy(self.state), not self.state["version"]
        # baskets without an id get one that no other batch has, and the same one whenever their split is read again
        own = F.concat(F.lit(f"null-{uuid.uuid4().hex}-"), F.monotonically_increasing_id().cast("string"))
        given = batch.select(F.coalesce(F.col(id_column).cast("string"), own).alias("id"), F.col(day).cast("date").alias("day"), term_keys(terms).alias("terms"))
        # equal arrivals collapse in the maximum, differing ones are ranked
        given = given.groupBy("id").agg(F.max(F.struct("day", "terms")).alias("s")).select("id", "s.day", "s.terms")
        if first:
            changed = given.select("id", F.lit(None).cast("date").alias("old_day"), F.lit(None).cast("array<string>").alias("old_terms"), "day", "terms", F.lit(True).alias("new"))
        else:
            given = cut(given, "given-baskets")
            near = sorted(r[0] for r in given.select(self._bucket("baskets", state)).distinct().collect())
            old = self._stored("baskets", state, near).select("id", F.col("day").alias("old_day"), F.col("terms").alias("old_terms"), F.lit(True).alias("known"))
            changed = given.join(old, "id", "left").where("known is null or not (day <=> old_day and terms <=> old_terms)").withColumn("new", F.col("known").isNull()).drop("known")
        written = cut(changed, "changed-baskets")
        if not first:
            discard(given)
        changed, size = written, F.size("terms").cast("bigint")
        n, new, held, pairs = changed.agg(F.count("*"), F.count_if("new"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * (size - 1) / 2).cast("bigint"), F.lit(0))).first()
        self.last = {"changed": n}
        if not n:
            discard(written)
            return
        state["records"] += new
        self.last["baskets"] = self._merge("baskets", changed, lambda old: old.join(changed.select("id"), "id", "left_anti").unionByName(changed.select("id", "day", "terms")), state, new)

        signed = changed.select(F.lit(1).cast("bigint").alias("sign"), "day", "terms")
        if not first:
            signed = signed.unionAll(changed.where("not new").select(F.lit(-1).cast("bigint"), "old_day", "old_terms"))
        terms_delta = signed.select("sign", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("sign").alias("n")).where("n <> 0")
        pairs_delta = emitted_pairs(signed).groupBy("term_a", "term_b", "day").agg(F.sum("sign").alias("count")).where("count <> 0")
        if not first:
            terms_delta, pairs_delta = cut(terms_delta, "marginals-delta"), cut(pairs_delta, "pairs-delta")
        add = lambda old, delta, keys, value: old.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) != 0) if not first else delta
        self.last["marginals"] = self._merge("marginals", terms_delta, lambda old: add(old, terms_delta, ["term"], "n"), state, held)
        self.last["pairs"] = self._merge("pairs", pairs_delta, lambda old: add(old, pairs_delta, ["term_a", "term_b", "day"], "count"), state, pairs)
        self.last["totals"] = self._merge("totals", pairs_delta, lambda old: self._totals(old, None if first else pairs_delta, state, self.last["pairs"]), state, pairs)
        self._commit(state)
        discard(written, *([] if first else [terms_delta, pairs_delta]))
        self._sweep()

    def _totals(self, old: DataFrame, delta: DataFrame | None, state: dict, buckets: list[int]) -> DataFrame:
        """The totals of the buckets: those of the affected pairs made anew from the pairs' days, the others as they are."""
        days, key = self._stored("pairs", state, buckets), ["term_a", "term_b"]
        if delta is not None:
            affected = delta.select(*key).distinct()
            days, old = days.join(affected, key, "left_semi"), old.join(affected, key, "left_anti")
        return old.unionByName(days.groupBy(*key).agg(F.sum("count").alias("count"), F.count("day").alias("distinct_days")))

    def _with_count(self, pairs: DataFrame, term: str, out: str) -> DataFrame:
        marginals, n = self._stored("marginals", self.state), F.col("n")
        often = n * SHARE >= self.state["records"]
        # at most SHARE times the mean basket's size of them
        known = pairs.join(F.broadcast(marginals.where(often).select(F.col("term").alias(term), n.alias("_often"))), term, "left")
        key = F.when(F.col("_often").isNull(), F.col(term)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64("term_a", "term_b"), F.lit(4096)).cast("string")))
        rest = marginals.where(~often).select(F.col("term").alias("_key"), n.alias("_n"))
        return known.withColumn("_key", key).join(rest, "_key", "left").withColumn(out, F.coalesce("_often", "_n")).drop("_key", "_often", "_n")

    def scores(self) -> DataFrame:
        """term_a, term_b, count, distinct_days, n_a, n_b, n_records, lift: how much oftener together than chance would have it."""
        n = self.state["records"]
        rows = self._with_count(self._with_count(self._stored("totals", self.state), "term_a", "n_a"), "term_b", "n_b")
        lift = F.col("count") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
        return rows.select("term_a", "term_b", "count", "distinct_days", "n_a", "n_b", F.lit(n).cast("bigint").alias("n_records"), lift.alias("lift"))
