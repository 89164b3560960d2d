"""Relational edge operators: closure, reciprocity, communities, weights, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtrust.functions.labels import UNTYPED


def closed_world(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both in ids (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def weighted_edges(edges: DataFrame, semantics: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All edges with intent, weight and confidence; an edge without a label gets the neutral values. key: what joins them, edge_id or both ends."""
    key = key or ["edge_id"]
    labels = semantics.select(*key, *UNTYPED, F.lit(True).alias("typed"))
    held = edges.join(labels, key, "left")
    return held.select(*edges.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in UNTYPED.items()], F.coalesce("typed", F.lit(False)).alias("typed"))


def with_reciprocal(edges: DataFrame) -> DataFrame:
    """A flag for edges whose reverse exists; a loop is its own reverse."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("back", F.lit(True))
    return edges.join(back, ["src", "dst"], "left").withColumn("reciprocal", F.coalesce("back", F.lit(False))).drop("back")


def with_communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The community of both ends, and whether they are the same one (false where either is unknown)."""
    a = nodes.select(F.col("id").alias("src"), F.col("community").alias("src_community"))
    b = nodes.select(F.col("id").alias("dst"), F.col("community").alias("dst_community"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("internal", F.coalesce(F.col("src_community") == F.col("dst_community"), F.lit(False)))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every node, in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    found = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(found, "id", "left").select("id", zero("o").alias("out_degree"), zero("i").alias("in_degree"), (zero("o") + zero("i")).alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, distinct, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
