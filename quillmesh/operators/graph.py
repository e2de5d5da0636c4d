"""Connections between notes: similar vectors, shared tags, shared entities; edges and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut

#: Notes shown for a shared tag or entity.
PER_GROUP = 10


def shared_tag_neighbours(rows: DataFrame, queries: DataFrame, per_group: int = PER_GROUP) -> DataFrame:
    """(doc_id, tag, other): for each queried note and tag of it the first other notes with that tag, by id.

    The first per_group + 1 notes of a tag suffice for every note, so the join meets that many rows of a tag.
    """
    w = Window.partitionBy("tag").orderBy("doc_id")
    pool = rows.select("tag", F.col("doc_id").alias("other")).distinct().withColumn("r", F.row_number().over(w.orderBy("other"))).where(F.col("r") <= per_group + 1)
    mine = rows.join(queries.select("doc_id"), "doc_id", "left_semi").select("doc_id", "tag").distinct()
    pairs = mine.join(pool, "tag").where(F.col("other") != F.col("doc_id"))
    n = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy("other"))
    return pairs.withColumn("n", n).where(F.col("n") <= per_group).select("doc_id", "tag", "other")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) once for each kind and pair, the smaller id first; loops are dropped."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "kind")
    return e.where(F.col("src") != F.col("dst")).distinct()


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of an edge is connected with, by alternating large and small stars.

    Rounds grow with the logarithm of the diameter; each is written to the shared checkpoint folder. A hub's rows are
    met with one row for it, so a skewed join is split by the adaptive planner, and its least neighbour is found
    before the shuffle. Null ends and loops are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    e, state = cut(e.distinct()), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        e = cut(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = now
