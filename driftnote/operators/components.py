"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id that is connected) for every end of an edge (src, dst).

    Alternating large and small stars: each round points neighbours at smaller ids, and the edges end as stars. It goes on until the edges don't change; rounds grow with the logarithm of the
    components' size; each is written to the shared folder, so lineage stays short and nothing is collected but a count.
    Edges with a null end are left out, loops make a component by themselves; no edges give no rows.
    """
    nodes = edges.where("src is not null and dst is not null")
    loops = nodes.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    e = cut(nodes.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")
    while True:
        # large star: every larger neighbour of a node points at the least of the node and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "stars")
        # settled when the edges don't change
        if new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").limit(1).count() == 0:
            discard(new)
            break
        discard(e)
        e = new
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return stars.unionAll(loops).groupBy("id").agg(F.min("component").alias("component"))
