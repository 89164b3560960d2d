"""Community scores: the composite index, its variants, baselines and ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphtrust.functions.labels import is_shallow
from graphtrust.functions.stats import average_rank, fixed, mean_of, pearson, percent_rank, zscore
from graphtrust.operators.edges import degrees, undirected, with_communities, with_reciprocal
from graphtrust.operators.graph import pageranks
from graphtrust.operators.ranking import draw, ranks
from graphtrust.runtime import checkpoint, drop_folder, spill

#: Features of the index, by z-score mean; the structural variant leaves the shallow share out.
FEATURES = ("density", "log_inflation", "reciprocity", "superficiality", "assortativity", "mean_pagerank_drop")
STRUCTURAL = tuple(f for f in FEATURES if f != "superficiality")


def flagged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with communities of both ends, `internal` and `reciprocal`, written, as several aggregates read them."""
    return spill(with_reciprocal(with_communities(edges, nodes)), "flagged-edges")


def _stats(inner: DataFrame) -> DataFrame:
    """Per community: counts and means over its internal edges, which are flagged and weighted (intent, weight, confidence, typed)."""
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return inner.groupBy(F.col("src_community").alias("community")).agg(
        F.count("*").alias("internal_edges"), n(F.col("reciprocal")).alias("reciprocal_edges"), n(F.col("typed")).alias("typed_edges"),
        n(is_shallow(F.col("intent")) & F.col("typed")).alias("shallow_edges"), F.avg("weight").alias("mean_weight"), F.avg("confidence").alias("mean_confidence"),
        *([pearson(F.log1p("x"), F.log1p("y")).alias("assortativity")] if "x" in inner.columns else []),
    )


def internal_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per community: counts and means over its internal edges. edges: weighted (intent, weight, confidence, typed)."""
    return _stats(with_reciprocal(with_communities(edges, nodes)).filter("internal"))


def degree_assortativity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per community: Pearson correlation over internal edges of log1p of the citing end's out- and the cited end's in-degree."""
    d = degrees(edges, nodes)
    inner = with_communities(edges, nodes).filter("internal")
    both = inner.join(d.selectExpr("id src", "out_degree x"), "src").join(d.selectExpr("id dst", "in_degree y"), "dst")
    return both.groupBy(F.col("src_community").alias("community")).agg(pearson(F.log1p("x"), F.log1p("y")).alias("assortativity"))


def pagerank_shifts(edges: DataFrame, nodes: DataFrame, stop: str = "n_tol", digits: int = 9) -> DataFrame:
    """(id, rank_plain, rank_trust, drop, delta, place_plain, place_trust, rank_drop): PageRank without weights and by `weight`, both to convergence.

    drop: plain less trust, delta: its opposite; places count from the largest rank, rounded to `digits` so that noise can't tell ties, and
    rank_drop is how many places trust takes a node down. Written.
    """
    both = checkpoint(pageranks(edges, nodes, {"rank_plain": None, "rank_trust": "weight"}, stop=stop))
    rows = both.select("id", "rank_plain", "rank_trust", fixed(F.col("rank_plain"), digits).alias("_p"), fixed(F.col("rank_trust"), digits).alias("_t"))
    rows = ranks(checkpoint(ranks(rows, "_p", "place_plain")), "_t", "place_trust").drop("_p", "_t")
    rows = rows.withColumns({"drop": F.col("rank_plain") - F.col("rank_trust"), "delta": F.col("rank_trust") - F.col("rank_plain"), "rank_drop": F.col("place_trust") - F.col("place_plain")})
    return checkpoint(rows.select("id", "rank_plain", "rank_trust", "drop", "delta", "place_plain", "place_trust", "rank_drop"))


def shift_extremes(shifts: DataFrame, metadata: DataFrame, wanted: list[str], n: int = 25) -> DataFrame:
    """(kind, id, rank_drop, drop, *those of `wanted` that metadata (id, ...) has): the n largest drops and the n largest gains of places, ties to the smaller id."""
    held = [c for c in wanted if c in metadata.columns]
    take = lambda kind, order: shifts.orderBy(order, "id").limit(n).select(F.lit(kind).alias("kind"), "id", "rank_drop", "drop")
    few = F.broadcast(take("drop", F.desc("rank_drop")).unionByName(take("gain", F.asc("rank_drop"))))  # 2n rows
    return few.join(metadata.select("id", *held), "id", "left").select("kind", "id", "rank_drop", "drop", *held)


_MEANS = {"mean_pagerank_drop": "drop", "mean_rank_drop": "rank_drop", "mean_weighted_pagerank": "rank_trust", "mean_unweighted_pagerank": "rank_plain"}


def community_scores(edges: DataFrame, nodes: DataFrame, shifts: DataFrame, denominator: str = "typed") -> DataFrame:
    """The composite index of each community of nodes (id, community). edges: weighted; shifts: pagerank_shifts of the same graph.

    denominator of the shallow share: typed (typed internal edges) or all. The flagged edges are written once; degrees, internal
    statistics and assortativity read them there.
    """
    e = flagged_edges(edges, nodes)
    d = checkpoint(degrees(e, nodes))
    base = nodes.join(d, "id").join(shifts.select("id", *_MEANS.values()), "id", "left").filter("community is not null").groupBy("community").agg(
        F.count("*").alias("size"), F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"), *[F.avg(c).alias(name) for name, c in _MEANS.items()]
    )
    inner = e.filter("internal").join(d.selectExpr("id src", "out_degree x"), "src").join(d.selectExpr("id dst", "in_degree y"), "dst")
    n_edges = e.agg(F.count("*").alias("n_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = base.join(_stats(inner), "community", "left").crossJoin(F.broadcast(n_edges))  # one row
    rows = rows.select(
        "community", "size", "out_degree", "in_degree", *[zero(c).alias(c) for c in ("internal_edges", "reciprocal_edges", "typed_edges", "shallow_edges")],
        F.coalesce("mean_weight", F.lit(1.0)).alias("mean_weight"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("assortativity", *_MEANS)], "n_edges",
    )
    rows = checkpoint(rows)
    drop_folder(e)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    possible = F.col("size") * (F.col("size") - 1)
    rows = rows.withColumns({
        "density": F.when(possible > 0, F.col("internal_edges") / possible).otherwise(0.0),
        "reciprocity": ratio("reciprocal_edges", "internal_edges"),
        "expected": F.col("out_degree") * F.col("in_degree") / F.greatest(F.col("n_edges"), F.lit(1)),
        "superficiality": ratio("shallow_edges", "typed_edges" if denominator == "typed" else "internal_edges"),
        "coverage": ratio("typed_edges", "internal_edges"),
    })
    rows = rows.withColumn("inflation", F.col("internal_edges") / F.greatest(F.col("expected"), F.lit(1e-9))).withColumn("log_inflation", F.log1p("inflation"))
    even = lambda f: F.col(f) * F.col("n_edges") if f == "mean_pagerank_drop" else F.col(f)  # noqa: E731  ranks shrink with the graph, so nine places of them would be too few
    rows = rows.withColumns({f"{f}_z": zscore(fixed(even(f), 9)) for f in FEATURES})
    rows = rows.withColumns({"cci": fixed(mean_of(*[F.col(f"{f}_z") for f in FEATURES])), "structural_cci": fixed(mean_of(*[F.col(f"{f}_z") for f in STRUCTURAL]))})
    return rows.withColumn("cci_rank", F.rank().over(Window.orderBy(F.desc("cci"))))


def precommunity_scores(edges: DataFrame, nodes: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Before any labels: density, reciprocity, and inflation over the undirected expectation vol^2 / 2m; `floor` bounds it from below. Flagged edges are taken as they are."""
    flagged = (edges if "src_community" in edges.columns else with_reciprocal(with_communities(edges, nodes))).filter("internal")
    inner = flagged.groupBy(F.col("src_community").alias("community")).agg(F.count("*").alias("internal_edges"), F.sum(F.col("reciprocal").cast("int")).cast("long").alias("reciprocal_edges"))
    pairs = undirected(edges)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    volume = ends.join(nodes.select("id", "community"), "id").groupBy("community").agg(F.count("*").alias("volume"))
    m = pairs.agg(F.count("*").alias("m"))
    rows = nodes.groupBy("community").agg(F.count("*").alias("size")).join(inner, "community", "left").join(volume, "community", "left").crossJoin(F.broadcast(m))
    zero = lambda c: F.coalesce(c, F.lit(0))
    possible = F.col("size") * (F.col("size") - 1)
    expected = zero("volume") * zero("volume") / (2.0 * F.greatest("m", F.lit(1)))
    return rows.select(
        "community", "size", zero("internal_edges").alias("internal_edges"), zero("reciprocal_edges").alias("reciprocal_edges"), zero("volume").alias("volume"),
        F.when(possible > 0, zero("internal_edges") / possible).otherwise(0.0).alias("density"),
        F.when(zero("internal_edges") > 0, zero("reciprocal_edges") / F.col("internal_edges")).otherwise(0.0).alias("reciprocity"),
        expected.alias("expected"), (zero("internal_edges") / F.greatest(expected, F.lit(floor))).alias("inflation"),
    )


def spearman(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman): Pearson correlation of average ranks. For tables of communities."""
    return scores.select(average_rank(a).alias("x"), average_rank(b).alias("y")).agg(pearson(F.col("x"), F.col("y")).alias("spearman"))


def overlap(scores: DataFrame, a: str, b: str, k: int, key: str = "community") -> DataFrame:
    """(overlap): the share of the k best by a that are among the k best by b; the denominator is what the first top really holds."""
    top = lambda c: scores.orderBy(F.desc(c), key).limit(k).select(key)
    both = top(a).join(top(b).withColumn("hit", F.lit(1.0)), key, "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("overlap"))


def compare(scores: DataFrame, names: dict[str, str], against: str = "cci", ks: tuple[int, ...] = (5, 10, 25), key: str = "community") -> DataFrame:
    """(score, spearman, overlap_at_k...) of each column of names (name: column) against another, in one pass over a table of communities.

    An overlap is the share of the k best by `against` that are among the k best by the column; its denominator is what the first
    top really holds. Ties go to the smaller key.
    """
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), key))
    rows = scores.withColumn("_top", place(against)).withColumn("_y", average_rank(against))
    long = None
    for name, c in names.items():
        part = rows.select(F.lit(name).alias("score"), "_top", "_y", place(c).alias("_own"), average_rank(c).alias("_x"))
        long = part if long is None else long.unionByName(part)
    share = lambda k: F.coalesce(F.try_divide(F.count_if((F.col("_top") <= k) & (F.col("_own") <= k)), F.count_if(F.col("_top") <= k)), F.lit(0.0))
    return long.groupBy("score").agg(fixed(pearson(F.col("_x"), F.col("_y"))).alias("spearman"), *[fixed(share(k)).alias(f"overlap_{k}") for k in ks])


#: The baselines by name, and their columns.
BASELINES = {
    "density_only": "density", "inflation_only": "log_inflation", "reciprocity_only": "reciprocity", "structural_only_without_semantic": "structural_cci",
    "semantic_only_superficiality": "superficiality", "random": "random_score",
}


def with_random(scores: DataFrame, seed: int, key: str = "community") -> DataFrame:
    """scores with random_score, from 0 to 1, reproducible."""
    return scores.withColumn("random_score", F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0)


def baselines(scores: DataFrame, seed: int = 42) -> DataFrame:
    """(score, spearman, overlap_5, overlap_10, overlap_25) of six baselines against the index; features are rounded, so that noise can't tell ties."""
    fine = {c: fixed(F.col(c)).alias(c) for c in BASELINES.values() if c not in ("structural_cci", "random_score")}
    return compare(checkpoint(with_random(scores.select("community", "cci", "structural_cci", *fine.values()), seed)), BASELINES)


def precision_rows(compared: DataFrame, ks: tuple[int, ...] = (5, 10, 25)) -> DataFrame:
    """(score, k, precision): the overlaps of compare(), a row for each."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"overlap_{k}").alias("precision")) for k in ks])
    return compared.select("score", F.explode(pairs).alias("p")).select("score", "p.k", "p.precision")


def without_each(scores: DataFrame) -> DataFrame:
    """The index without each feature in turn, beside the whole."""
    kept = {f: [F.col(f"{g}_z") for g in FEATURES if g != f] for f in FEATURES}
    return scores.select("community", "cci", *[fixed(mean_of(*cols)).alias(f"without_{f}") for f, cols in kept.items()])


def ablations(scores: DataFrame) -> DataFrame:
    """(score, spearman, overlap_5, overlap_10, overlap_25) of the index without each feature (score: its name) against the whole."""
    return compare(checkpoint(without_each(scores)), {f: f"without_{f}" for f in FEATURES})


def adaptive_ranking(scores: DataFrame, typed: DataFrame, nodes: DataFrame, least_edges: int = 10, top: int = 10) -> DataFrame:
    """Communities to label next, by the sum of four percent ranks: inflation, density, reciprocity and the shallow share among typed internal edges.

    scores: before annotation. Only communities with least_edges typed internal edges count, unless none has as many. A missing mean
    weight gets the median of the others. Ties go to the smaller community.
    """
    inner = with_communities(typed, nodes).filter("internal").groupBy(F.col("src_community").alias("community")).agg(
        F.count("*").alias("typed_seen"), F.avg(is_shallow(F.col("intent")).cast("int")).alias("shallow_share"), F.avg("weight").alias("seen_weight")
    )
    rows = scores.select("community", "density", "inflation", "reciprocity", "size").join(inner, "community", "left")
    rows = checkpoint(rows.withColumn("typed_seen", F.coalesce("typed_seen", F.lit(0))))
    middle = rows.agg(F.median("seen_weight").alias("middle"), F.coalesce(F.max("typed_seen"), F.lit(0)).alias("most"))
    rows = rows.crossJoin(F.broadcast(middle)).filter((F.col("typed_seen") >= least_edges) | (F.col("most") < least_edges))  # one row
    rows = rows.withColumn("mean_weight", fixed(F.coalesce("seen_weight", "middle", F.lit(1.0)), 9)).withColumn("shallow_share", F.coalesce("shallow_share", F.lit(0.0)))
    ranked = ("inflation", "density", "reciprocity", "shallow_share")
    rows = rows.withColumns({c: fixed(F.col(c), 9) for c in ranked})
    rows = rows.withColumn("adaptive_score", fixed(sum((percent_rank(c) for c in ranked[1:]), percent_rank(ranked[0]))))
    return rows.orderBy(F.desc("adaptive_score"), "community").limit(top).select("community", "size", "typed_seen", "shallow_share", "mean_weight", "adaptive_score")


def rough_candidates(scores: DataFrame, top: int) -> DataFrame:
    """(community): the most suspicious before any labels, by the sum of the percent ranks of density, inflation and reciprocity."""
    rows = scores.select("community", *[fixed(F.col(c), 9).alias(c) for c in ("density", "inflation", "reciprocity")])
    rough = fixed(percent_rank("density") + percent_rank("inflation") + percent_rank("reciprocity"))
    return rows.withColumn("rough", rough).orderBy(F.desc("rough"), "community").limit(top).select("community")
