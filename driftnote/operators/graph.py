"""Links between notes: resolving them, degrees, neighbourhoods, and diffusion over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard

CLIQUE = 25


def link_target(link: Column) -> Column:
    return F.trim(F.regexp_replace(link, r"(?s)[#|^].*$", ""))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def resolve(links: DataFrame, paths: DataFrame) -> DataFrame:
    """link, path for each distinct link: the note whose stem, file name or path without suffix is the link's target, else the one whose stem is the target's; the
    shallowest, then the first by name. Unresolved links have a null path. Only distinct links are joined, so a link that everyone writes is one row."""
    wanted = links.select("link").where("link is not null").distinct().withColumn("target", link_target(F.col("link"))).where("target <> ''")
    p = paths.select("path").where("path is not null").distinct().withColumn("depth", F.size(F.split("path", "/")))
    aliases = p.select("path", "depth", F.explode(F.array_distinct(F.array(stem(F.col("path")), F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"\.[^./]*$", "")))).alias("alias"))
    best = aliases.groupBy("alias").agg(F.min(F.struct("depth", "path")).alias("b")).select("alias", F.col("b.path").alias("path"))
    tries = wanted.select("link", F.posexplode(F.array("target", stem(F.col("target")))).alias("at", "alias"))
    found = tries.join(best, "alias", "left")
    return found.groupBy("link").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("at"))).alias("path"))


def linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Directed pairs (src, dst), both ways, of the notes that links (note_id, key) name among the nodes; not yet distinct."""
    return links.join(nodes.select(F.col("note_id").alias("dst"), "key"), "key").where("note_id <> dst").select(F.explode(_both_ways(F.col("note_id"), F.col("dst"))).alias("p")).select("p.*")


def grouped(nodes: DataFrame) -> DataFrame:
    """note_id, day, g: the tags and the folder of each node, each once."""
    groups = F.array_union(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), F.array(F.concat(F.lit("/"), "folder")))
    return nodes.select("note_id", "day", F.explode(groups).alias("g")).distinct()


def neighbourhood(nodes: DataFrame, links: DataFrame, clique: int = CLIQUE) -> DataFrame:
    """Directed pairs (src, dst), both ways: linked notes, and notes that share a tag or a folder, of each of which the ``clique`` newest are paired.

    nodes: note_id, key, folder, day, tags. links: note_id, key. The rank is kept to the clique before the self-join, so a tag in a third of all notes pairs no more than any other.
    """
    w = Window.partitionBy("g").orderBy(F.col("day").desc(), F.col("note_id").desc())
    kept = grouped(nodes).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= clique)
    together = kept.where("g is not null").groupBy("g").agg(F.collect_list("note_id").alias("ids")).select(F.explode("ids").alias("src"), "ids").select("src", F.explode("ids").alias("dst")).where("src <> dst")
    return linked(nodes, links).unionAll(together).distinct()


def _both_ways(a: Column, b: Column) -> Column:
    return F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))


def diffuse(vectors: DataFrame, edges: DataFrame, steps: int = 2, alpha: float = 0.35) -> DataFrame:
    """Sparse vectors (note_id, feature, weight) after rounds of (1 - alpha) * own + alpha * the mean of the neighbours', each of unit length.

    A round is a join on the edge, one sum of the own and the neighbours' weights, added up before the shuffle, and the norms of each note; it is written to the shared
    folder: lineage doesn't grow with the rounds.
    """
    w, before = Window.partitionBy("note_id"), ""
    for _ in range(steps):
        near = edges.join(vectors.withColumnRenamed("note_id", "dst"), "dst").select(F.col("src").alias("note_id"), "feature", F.lit(0.0).alias("own"), F.col("weight").alias("near"))
        rows = near.unionAll(vectors.select("note_id", "feature", F.col("weight").alias("own"), F.lit(0.0).alias("near"))).groupBy("note_id", "feature").agg(F.sum("own").alias("own"), F.sum("near").alias("near"))
        rows = rows.withColumn("norm", F.sqrt(F.sum(F.col("near") * F.col("near")).over(w)))
        mixed = F.when(F.col("norm") > 0, F.col("own") * (1 - alpha) + F.col("near") / F.col("norm") * alpha).otherwise(F.col("own"))
        after = cut(unit(rows.select("note_id", "feature", mixed.alias("weight"))), "diffused")
        discard(before)
        vectors = before = after
    return vectors


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors of unit length."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("note_id")))
    return vectors.withColumn("weight", F.col("weight") / F.when(norm > 0, norm).otherwise(1.0))
