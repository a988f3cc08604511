"""References to records that do not exist.

A reference is a composite key whose columns may be null in part. References are
grouped by their null mask, and each mask is anti-joined with the parents on its
non-null columns; what a null means is the declared match semantics:

* ``simple``: a reference with any null column is satisfied (no orphan);
* ``partial``: the non-null columns must equal those of some parent; all null is satisfied;
* ``full``: all columns null is satisfied, a mix of null and non-null is an orphan.

A parent may hold for a while only: from ``since`` up to, not including, ``until``
(null = open on that side). A reference whose instant is null is met by a parent at any time.

Scale: of the references only the distinct (key, instant) pairs meet the parents, after a
map-side combine, so that a key holding a third of all references comes down to one row an
instant, with their number. The verdict goes back to the references over a salted key: an orphan key is repeated as often as it
has ``rows_a_salt`` references, those spread over as many salts, whatever key is hot. How often that is for the few keys with more than one salt goes along with the
references, as a broadcast of at most ``SPLIT`` rows (``rows_a_salt`` is at least that part of all references). Nothing else is broadcast by force and nothing is collected but a count.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_SALT = 2_000_000
SPLIT = 10_000


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    columns: list[str],
    parent_columns: list[str] | None = None,
    match: str = "simple",
    at: str | None = None,
    since: str | None = None,
    until: str | None = None,
    rows_a_salt: int = ROWS_A_SALT,
) -> DataFrame:
    """The rows of ``refs`` that refer to no row of ``parents``.

    ``columns`` of ``refs`` against ``parent_columns`` (the same names if not given) of ``parents``;
    ``at``, ``since`` and ``until`` as in the module's text. Parents with a null in a compared column
    match nothing there. Rows that come twice come out twice; no references or no parents give none
    or all of the checked ones; further columns, of whatever name, are kept and don't clash.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match is simple, partial or full, not {match!r}")
    parent_columns = parent_columns or columns
    k = len(columns)
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"r.`{c}`").isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)])
    tagged = refs.alias("r").select(
        F.struct("r.*").alias("row"),
        *[F.col(f"r.`{c}`").alias(f"k{i}") for i, c in enumerate(columns)],
        (F.col(f"r.`{at}`") if at else F.lit(None).cast("date")).alias("t"),
        mask.alias("mask"),
    )
    held = parents.select(
        *[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(parent_columns)],
        (F.col(f"`{since}`") if since else F.lit(None).cast("date")).alias("since"),
        (F.col(f"`{until}`") if until else F.lit(None).cast("date")).alias("until"),
    ).distinct()
    every = (1 << k) - 1
    total = refs.count()
    rows_a_salt = max(rows_a_salt, -(-total // SPLIT))
    out = []
    for bits in product((0, 1), repeat=k):
        m = sum(b << i for i, b in enumerate(bits))
        # a mask that no row has costs one filtered branch; nullability prunes it where the schema says so
        if any(b and not refs.schema[c].nullable for b, c in zip(bits, columns)):
            continue
        part = tagged.where(F.col("mask") == m)
        if m == every or (m and match == "simple"):
            continue
        if m and match == "full":
            out.append(part.select("row"))
            continue
        on = [i for i, b in enumerate(bits) if not b]
        keys = [f"k{i}" for i in on]
        wanted = part.groupBy(*keys, "t").agg(F.count("*").alias("n"))
        met = reduce(lambda a, b: a & b, [F.col(f"k{i}") == F.col(f"p{i}") for i in on])
        if since or until:
            t = F.col("t")
            met = met & (t.isNull() | F.col("since").isNull() | (F.col("since") <= t)) & (t.isNull() | F.col("until").isNull() | (F.col("until") > t))
        missing = wanted.join(held, met, "left_anti").select(*[F.col(c).alias(f"o_{c}") for c in keys], F.col("t").alias("o_t"), (F.ceil(F.col("n") / rows_a_salt)).cast("int").alias("salts"), F.xxhash64(*keys, "t").alias("h"))
        salts = F.lit(1)
        if total > rows_a_salt:
            # at most SPLIT keys; two of one hash get the salts of both, which is as right
            hot = missing.where("salts > 1").groupBy("h").agg(F.max("salts").alias("hot_salts")).withColumnRenamed("h", "hot_h")
            missing = missing.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
            part = part.join(F.broadcast(hot), F.xxhash64(*keys, "t") == F.col("hot_h"), "left")
            salts = F.coalesce("hot_salts", F.lit(1))
        missing = missing.withColumn("o_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*[f"o_{c}" for c in keys], "o_t", "o_salt")
        salted = part.withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"o_{c}") for c in keys]) & F.col("t").eqNullSafe(F.col("o_t")) & (F.col("salt") == F.col("o_salt"))
        out.append(salted.join(missing, same, "left_semi").select("row"))
    if not out:
        return refs.limit(0)
    return reduce(DataFrame.unionAll, out).select("row.*")
