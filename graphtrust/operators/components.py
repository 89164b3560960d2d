"""Connected components over an edge table, for any orderable node type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtrust.runtime import checkpoint, observed, partitions


#: See _hook; broadcasts at most so many nodes.
OFTEN = 4096


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _hook(pairs: DataFrame, most: int) -> DataFrame:
    """(u, v, m) with the least neighbour m of u, for distinct pairs of which there are at most `most`.

    The minimum is pre-aggregated. A hub, a node with more than one in OFTEN of `most` pairs, gets its m by broadcast, so
    that no task gathers its pairs; there are fewer than OFTEN hubs.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    is_hub = F.col("n") * OFTEN > most
    hubs = F.broadcast(least.filter(is_hub).drop("n"))
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.filter(~is_hub).drop("n"), "u")
    return pairs.join(hubs, "u").unionByName(rest)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of a non-loop edge; component is the least node reachable.

    Alternating large-star and small-star steps: O(log n) rounds, each with shuffles of at most the
    edges' size and a checkpoint. Null ends, loops and repeated edges have no effect; no edges: no rows.
    """
    a, b = F.col(src), F.col(dst)
    now = checkpoint(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = _signature(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _hook(both, 2 * seen[0]).withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        hooked = _hook(checkpoint(large), 2 * seen[0])
        small = hooked.select("u", F.col("m").alias("v")).unionByName(
            hooked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        now = checkpoint(small)
        was, seen = seen, _signature(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components have not converged")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def linked(edges: DataFrame, *also: str) -> DataFrame:
    """(src, dst, *also) of an undirected graph: each link once each way, loops left out, of repeated edges the largest of `also`.

    Kept by src (unpersist() it when done), so that rounds over it shuffle rows of nodes and of messages only.
    """
    some = edges.filter("src <> dst").select("src", "dst", *also)
    turn = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *also)
    both = some.select(F.explode(F.array(turn("src", "dst"), turn("dst", "src"))).alias("e")).select("e.*")
    return kept_by(both.repartition(partitions(some), "src").groupBy("src", "dst").agg(*[F.max(c).alias(c) for c in also]) if also else both.repartition(partitions(some), "src").distinct())


def kept_by(arcs: DataFrame) -> DataFrame:
    """arcs, which are partitioned by src, sorted and persisted."""
    return arcs.sortWithinPartitions("src").persist()


def _rooted(hooks: DataFrame) -> DataFrame:
    """(id, root) from (id, up), where every up is an id and the least above it is its own: pointers double until none changes."""
    now = checkpoint(hooks.select("id", F.col("up").alias("root")))
    while True:
        one, two = now.selectExpr("id root", "root r1"), now.selectExpr("id r1", "root r2")
        far = now.join(one, "root").join(two, "r1").select("id", F.col("r2").alias("root"), (F.col("r2") != F.col("root")).alias("moved"))
        new, seen = observed(far, F.count_if("moved").alias("moved"))
        now = new.select("id", "root")
        if not seen["moved"]:
            return now


def roots(arcs: DataFrame) -> DataFrame:
    """(id, root) of every node of arcs (src, dst), which stand both ways: the least node reachable.

    Each node hooks to its least neighbour if that is less, trees shrink to their roots, and links between roots go on: of a node's d
    neighbours one in d + 1 nodes stays a root, of a path half. A round moves its links twice, the first one's not by src if linked() kept them.
    """
    names, links = None, arcs.select("src", "dst")
    while True:
        hooks = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up")).select("id", F.least("id", "up").alias("up"))
        found = _rooted(hooks)
        if names is None:
            names = found
        else:
            names = checkpoint(names.join(found.selectExpr("id root", "root r"), "root", "left").select("id", F.coalesce("r", "root").alias("root")))
        a, b = found.selectExpr("id src", "root x"), found.selectExpr("id dst", "root y")
        left = links.filter("src < dst").join(a, "src").join(b, "dst").filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        left, seen = observed(left, F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            return names
        links = left.selectExpr("x src", "y dst").unionByName(left.selectExpr("y src", "x dst"))
