"""Prediction errors over diffused voltages, conflicts between states, and the energy that both make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recurrence import leaky_fold

# -- fixed values: how states press on each other, and which are at odds
NEIGHBOURS = {
    "Experiment": {"Thesis": 0.42, "Career": 0.18, "AI_Memory": 0.16, "Health": 0.14},
    "Thesis": {"Experiment": 0.38, "Career": 0.22, "AI_Memory": 0.14, "Health": 0.16},
    "Career": {"Thesis": 0.26, "Experiment": 0.16, "AI_Memory": 0.30, "Health": 0.18},
    "AI_Memory": {"Career": 0.28, "Experiment": 0.18, "Thesis": 0.16},
    "Health": {"Experiment": 0.24, "Thesis": 0.24, "Career": 0.18},
}
CONFLICTS = {("Experiment", "Career"): 0.34, ("Experiment", "Health"): 0.42, ("Thesis", "Career"): 0.30, ("Thesis", "Health"): 0.36, ("AI_Memory", "Thesis"): 0.20}
MICRO, MACRO, LEAST_MICRO, MOST_MICRO, TARGET_RATE, ETA = 0.55, 1.00, 0.35, 0.85, 0.35, 0.08
ALPHA, ERROR_WEIGHT, KEEP, INPUT, COMPLETION, PERSISTENT = 0.15, 0.45, 0.86, 0.16, 0.12, 0.28
META, META_TERMS, FLOOR = 2.15, {"error_ema": 0.55, "conflict": 0.85, "global_voltage": 0.35, "low_completion": 0.45, "micro_density": 0.25}, 0.25


def _by_state(table: dict[str, dict[str, float]]) -> Column:
    return F.create_map(*[x for s, m in table.items() for x in (F.lit(s), F.create_map(*[y for t, w in m.items() for y in (F.lit(t), F.lit(w))]))])


def diffused(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with (state, ratio) on a grid of all states a day: each ratio plus ALPHA times the weighted mean of its neighbours'.

    A day has as many rows as there are states, so the neighbours are looked up in the day's map of ratios: one window over (keys, day), no join.
    """
    day = Window.partitionBy(*keys, "day")
    ratios = F.map_from_entries(F.collect_list(F.struct("state", "ratio")).over(day))
    weights = _by_state(NEIGHBOURS)[F.col("state")]
    pressed = F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.col("_ratios")[e["key"]], F.lit(0.0)))
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, w: a + w)
    return points.withColumn("_ratios", ratios).withColumn("diffused", F.col("ratio") + ALPHA * pressed / total).drop("_ratios")


def predicted(points: DataFrame, keys: list[str]) -> DataFrame:
    """Each state's prediction of the next diffused ratio, the error's running mean, micro and macro marks; a fold over the state's days.

    points: keys, state, day, ratio, diffused, evidence, completion, theta.
    """
    num = ["old_diffused", "old_input", "old_completion", "ema", "ratio", "diffused", "predicted", "error", "effective", "completion", "theta"]
    start = F.struct(F.lit(False).alias("seen"), F.lit(0).alias("streak"), *[F.lit(0.0).alias(n) for n in num], F.lit(False).alias("micro"), F.lit(False).alias("macro"))
    share = lambda x, theta: F.when(theta <= 0, 0.0).otherwise(F.least(F.greatest(x / F.greatest(theta, F.lit(1e-9)), F.lit(0.0)), F.lit(1.5)))

    def step(s: Column, r: Column) -> Column:
        guess = s["old_diffused"] * KEEP + s["old_input"] * INPUT - s["old_completion"] * COMPLETION + s["ema"] * PERSISTENT
        guess = F.when(s["seen"], F.least(F.greatest(guess, F.lit(0.0)), F.lit(2.5))).otherwise(0.0)

        def with_error(p: Column) -> Column:
            ema = 0.72 * s["ema"] + 0.28 * F.abs(r["diffused"] - p)

            def with_ema(e: Column) -> Column:
                effective = r["diffused"] + ERROR_WEIGHT * e
                micro = effective >= MICRO
                streak = F.when(micro, s["streak"] + 1).otherwise(0)
                macro = (r["ratio"] >= MACRO) | (micro & (streak >= 3) & (effective >= max(MACRO * 0.82, MICRO)))
                return F.struct(
                    F.lit(True).alias("seen"), streak.alias("streak"), r["diffused"].alias("old_diffused"), share(r["evidence"], r["theta"]).alias("old_input"), share(r["completion"], r["theta"]).alias("old_completion"), e.alias("ema"),
                    r["ratio"].alias("ratio"), r["diffused"].alias("diffused"), p.alias("predicted"), F.abs(r["diffused"] - p).alias("error"), effective.alias("effective"), r["completion"].alias("completion"), r["theta"].alias("theta"),
                    micro.alias("micro"), macro.alias("macro"),
                )

            return F.transform(F.array(ema), with_ema)[0]

        return F.transform(F.array(guess), with_error)[0]

    rows = points.select(*keys, "state", "day", "ratio", "diffused", "evidence", "completion", "theta")
    out = leaky_fold(rows, [*keys, "state"], start, step)
    return out.select(*keys, "state", "day", "ratio", "diffused", "predicted", "error", F.col("ema").alias("error_ema"), "effective", "micro", "macro", "streak", "completion", "theta")


def homeostasis(points: DataFrame, keys: list[str]) -> DataFrame:
    """How far each state's micro threshold moves after a run, and its last point."""
    rate = F.avg(F.col("micro").cast("double"))
    delta = F.least(F.greatest(ETA * (rate - TARGET_RATE), F.lit(LEAST_MICRO - MICRO)), F.lit(MOST_MICRO - MICRO))
    return points.groupBy(*keys, "state").agg(F.count_if("micro").alias("micro"), F.count_if("macro").alias("macro"), delta.alias("threshold_delta"), F.max_by("error_ema", "day").alias("last_error"))


def meta_energy(points: DataFrame, keys: list[str]) -> DataFrame:
    """The energy of each point: its error, its conflicts with the day's other states, the day's mean voltage, its gap in completion, the day's share of micro marks."""
    table: dict[str, dict[str, float]] = {}
    for (a, b), w in CONFLICTS.items():
        table.setdefault(a, {})[b] = w
        table.setdefault(b, {})[a] = w
    day = Window.partitionBy(*keys, "day")
    weights = _by_state(table)[F.col("state")]
    own = F.greatest("effective", F.lit(0.0))
    conflict = F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + e["value"] * own * F.greatest(F.coalesce(F.col("_effective")[e["key"]], F.lit(0.0)), F.lit(0.0)))
    rows = points.withColumn("_effective", F.map_from_entries(F.collect_list(F.struct("state", "effective")).over(day))).withColumns(
        {
            "conflict": F.coalesce(conflict, F.lit(0.0)),
            "global_voltage": F.avg(F.greatest("ratio", F.lit(0.0))).over(day),
            "micro_density": F.avg(F.col("micro").cast("double")).over(day),
            "low_completion": F.least(F.greatest((FLOOR - F.col("completion") / F.col("theta")) / FLOOR, F.lit(0.0)), F.lit(1.0)),
        }
    )
    energy = sum((F.col(t) * w for t, w in META_TERMS.items()), F.lit(0.0))
    return rows.drop("_effective").withColumn("energy", energy)


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, w) for a, m in NEIGHBOURS.items() for b, w in m.items()], "state string, other string, weight double")
