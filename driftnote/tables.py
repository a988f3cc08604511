"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once a row, whoever reads them. A plain projection is copied into every filter and expression above it, which for a costly
    column means once a reader; a generator of one row isn't."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, of rows that are equal but for their arrival; rows with a null key are kept, each on its own. Few keys come twice, so the rows are put
    together first and no combining (which would sort the texts on both sides) is tried before the shuffle. Where a query reduces its rows a lot, it
    rather does that first and takes each key once among what is left."""
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_alone", alone).repartition(key, "_alone").dropDuplicates([key, "_alone"]).drop("_alone")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer splits than there are cores: for costly work on each row of a small table. A large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the last ``order``. Rows with a null key are kept, each on its own.

    A key has few rows (arrivals of one record), so the window's groups are small.
    """
    # a null key gets a number of its own, the same one whenever its split is read again
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    rows = df.withColumn("_alone", alone)
    w = Window.partitionBy(key, "_alone").orderBy(F.col(order).desc_nulls_last())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_alone")
