"""Selections of edges to label: quotas by pool with a filler, groups that exclude one another, pairs of low similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtrust.functions import text
from graphtrust.operators.ranking import draw, keep_first, sample
from graphtrust.runtime import checkpoint

#: Shares of the pools for pilot, calibration and final labels, in the order in which an edge of several pools counts.
PILOT = (("random", 0.25), ("dense", 0.20), ("inflated", 0.15), ("reciprocal", 0.10), ("touching", 0.10))
CALIBRATION = (("low_similarity", 0.30), ("reciprocal", 0.20), ("inflated", 0.20), ("dense", 0.15), ("random", 0.15))
FINAL = (("low_similarity", 0.15), ("random", 0.20), ("dense", 0.20), ("inflated", 0.15), ("reciprocal", 0.15), ("touching", 0.15))
#: Shares of the groups to infer, targeted and adaptive.
TARGETED = {"reciprocal": 0.05, "inflated": 0.25, "dense": 0.20, "touching": 0.20, "low_similarity": 0.15, "random_control": 0.15}
ADAPTIVE = {"top_internal": 0.35, "top_boundary": 0.20, "inflated_internal": 0.15, "low_similarity": 0.15, "random_control": 0.15}


def with_texts(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """edges with citing_title, citing_abstract, cited_title and cited_abstract from papers (id, title, abstract); what is unknown is empty."""
    out = edges
    for end, name in (("src", "citing"), ("dst", "cited")):
        side = papers.select(F.col("id").alias(end), F.col("title").alias(f"{name}_title"), F.col("abstract").alias(f"{name}_abstract"))
        out = out.join(side, end, "left")
    columns = [f"{name}_{c}" for name in ("citing", "cited") for c in ("title", "abstract")]
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def similarity(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """edges (edge_id, src, dst) with lexical_jaccard: of the tokens of both ends' titles and abstracts, the first 1,200 characters of each."""
    both = with_texts(edges, papers)
    a, b = (text.tokens(text.clipped(F.col(f"{name}_title"), F.col(f"{name}_abstract"))) for name in ("citing", "cited"))
    return both.select(*edges.columns, text.jaccard(a, b).alias("lexical_jaccard"))


def low_similarity(candidates: DataFrame, papers: DataFrame, n: int, seed: int, most: int) -> DataFrame:
    """The n candidates (edge_id, src, dst) of least similarity among a sample of `most`, with lexical_jaccard; ties to the smaller edge_id."""
    some = sample(keep_first(candidates.select("edge_id", "src", "dst"), "edge_id", F.col("src")), "edge_id", most, seed)
    return similarity(some, papers).orderBy("lexical_jaccard", "edge_id").limit(max(0, n))


def by_quota(pools: DataFrame, shares: tuple[tuple[str, float], ...], target: int, seed: int, filler: str, filler_seed: int, low: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(edge_id, pool): of each pool its share of `target`, an edge of several pools under the first; then `filler` edges of any pool up to the target.

    pools: (edge_id, pool), written. low: (edge_id) for the pool low_similarity, chosen before. strict: ValueError where all pools
    together hold fewer than target.
    """
    picked = None
    for k, (name, share) in enumerate(shares):
        rows = low if name == "low_similarity" else sample(pools.filter(F.col("pool") == name).select("edge_id").distinct(), "edge_id", int(target * share), seed)
        rows = rows.select("edge_id", F.lit(name).alias("pool"), F.lit(k).alias("_k"))
        picked = rows if picked is None else picked.unionByName(rows)
    picked = checkpoint(keep_first(picked, "edge_id", F.col("_k")).drop("_k"))
    rest = pools.select("edge_id").distinct().join(picked, "edge_id", "left_anti")
    out = checkpoint(picked.unionByName(sample(rest, "edge_id", target - picked.count(), filler_seed).withColumn("pool", F.lit(filler))))
    if strict and (found := out.count()) < target:
        raise ValueError(f"only {found} edges are there for a target of {target}")
    return out


def exclusively(steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], used: DataFrame) -> DataFrame:
    """(edge_id, selection_group): group after group, each made by a function that is given the edge_ids used so far and returns others.

    Each group is cut from its lineage before the next, which otherwise would make all before it again.
    """
    used, out = used.select("edge_id").distinct(), None
    for name, make in steps:
        rows = checkpoint(make(used).select("edge_id", F.lit(name).alias("selection_group")))
        used = used.unionByName(rows.select("edge_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def unused(rows: DataFrame, used: DataFrame, n: int, seed: int) -> DataFrame:
    """(edge_id): a sample of the rows' edge_ids that aren't used."""
    return sample(rows.select("edge_id").distinct().join(used, "edge_id", "left_anti"), "edge_id", n, seed)


def in_turn(rows: DataFrame, key: str, n: int, seed: int, models: int) -> DataFrame:
    """(key, turn, model): a sample of n rows in random order, dealt to the models one by one. n bounds the one task that numbers them."""
    from pyspark.sql.window import Window

    order = Window.orderBy(draw(key, seed), key)
    turn = sample(rows.select(key), key, n, seed).withColumn("turn", F.row_number().over(order))
    return turn.withColumn("model", F.pmod(F.col("turn") - 1, F.lit(models)))
