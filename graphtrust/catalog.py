"""All registered queries of the graph engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphtrust.functions import labels as L
from graphtrust.functions import stats, text
from graphtrust.functions.stats import fixed
from graphtrust.operators import edges as E
from graphtrust.operators import graph as G
from graphtrust.operators import prototype as O
from graphtrust.operators import ranking as R
from graphtrust.operators import resilience as C
from graphtrust.operators import scores as S
from graphtrust.operators import stability as B
from graphtrust.operators import student as T
from graphtrust.operators.components import connected_components
from graphtrust.plans import project as P
from graphtrust.runtime import checkpoint, spill, table
from graphtrust.sources.batches import Prices

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a query by its name; sql: the rest of a WITH that begins with the projection's views, or whole where views is False."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {P.SQL}{sql}" if views else sql
        return f

    return put


def weighted(spark, sf: str) -> DataFrame:
    e = P.edges(spark, sf)
    return E.weighted_edges(e, P.semantics(e))


def weighted_pairs(spark, sf: str) -> DataFrame:
    """weighted without edge ids, joined by both ends, so that no digest is made or moved; written, as ranks and scores read it several times."""
    e = P.pairs(spark, sf)
    return spill(E.weighted_edges(e, P.semantics(e), ["src", "dst"]), "weighted-pairs")


def r6(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


def r9(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1000000000.0::DOUBLE + 0.5::DOUBLE) / 1000000000.0::DOUBLE"


# ---- ingest and edges


@query("SELECT edge_id, src, dst FROM edges")
def sha1_edge_ids(spark, sf):
    return P.edges(spark, sf)


@query(", held AS (SELECT id FROM nodes WHERE community < 'Brand#4') SELECT edge_id, src, dst FROM edges WHERE src IN (SELECT id FROM held) AND dst IN (SELECT id FROM held)")
def closed_world(spark, sf):
    return E.closed_world(P.edges(spark, sf), P.nodes(spark, sf).filter("community < 'Brand#4'"))


@query("SELECT edge_id, src, dst, reciprocal FROM flagged")
def reciprocal_edges(spark, sf):
    return E.with_reciprocal(P.edges(spark, sf)).select("edge_id", "src", "dst", "reciprocal")


@query("SELECT edge_id, src, dst, intent, weight, confidence, typed FROM weighted")
def weighted_edges(spark, sf):
    return weighted(spark, sf)


@query("SELECT edge_id, src_community, dst_community, internal FROM flagged")
def community_edges(spark, sf):
    return E.with_communities(P.edges(spark, sf), P.nodes(spark, sf)).select("edge_id", "src_community", "dst_community", "internal")


@query("SELECT n.id, coalesce(o.d, 0)::BIGINT AS out_degree, coalesce(i.d, 0)::BIGINT AS in_degree, (coalesce(o.d, 0) + coalesce(i.d, 0))::BIGINT AS degree FROM nodes n LEFT JOIN outdeg o USING (id) LEFT JOIN indeg i USING (id)")
def degrees(spark, sf):
    return E.degrees(P.edges(spark, sf), P.nodes(spark, sf))


_DEGREES = ", deg AS (SELECT n.id, n.community, coalesce(o.d, 0)::BIGINT AS o, coalesce(i.d, 0)::BIGINT AS i, (coalesce(o.d, 0) + coalesce(i.d, 0))::BIGINT AS d FROM nodes n LEFT JOIN outdeg o USING (id) LEFT JOIN indeg i USING (id))"


@query(_DEGREES + f"""
    SELECT count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, {r6('avg(d)')} AS mean_degree, max(d) AS max_degree, list_sort(list(d))[(count(*) // 2 + 1)::INTEGER] AS upper_median,
        count(*) FILTER (WHERE o > 0 AND i > 0) AS both_ways, count(*) FILTER (WHERE o = 0 AND i > 0) AS sinks, count(*) FILTER (WHERE o > 0 AND i = 0) AS sources, count(*) FILTER (WHERE d = 0) AS isolates,
        (sum(o) > 2 * count(*) AND count(*) FILTER (WHERE d = 0) = 0 AND count(*) FILTER (WHERE o > 0 AND i > 0) * 2 > count(*)) AS pass FROM deg""")
def degree_profile(spark, sf):
    n = lambda c: F.count_if(c)
    o, i, d = F.col("out_degree"), F.col("in_degree"), F.col("degree")
    return E.degrees(P.edges(spark, sf), P.nodes(spark, sf)).agg(
        F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"), fixed(F.avg("degree")).alias("mean_degree"), F.max("degree").alias("max_degree"), stats.upper_median("degree").alias("upper_median"),
        n((o > 0) & (i > 0)).alias("both_ways"), n((o == 0) & (i > 0)).alias("sinks"), n((o > 0) & (i == 0)).alias("sources"), n(d == 0).alias("isolates"),
        ((F.sum(o) > 2 * F.count("*")) & (n(d == 0) == 0) & (n((o > 0) & (i > 0)) * 2 > F.count("*"))).alias("pass"),
    )


@query(_DEGREES + "SELECT CASE WHEN d = 0 THEN -1 ELSE length(CAST(d AS VARCHAR)) - 1 END AS decade, count(*) AS n FROM deg GROUP BY 1")
def decade_histogram(spark, sf):
    decade = F.when(F.col("degree") == 0, -1).otherwise(F.length(F.col("degree").cast("string")) - 1)
    return E.degrees(P.edges(spark, sf), P.nodes(spark, sf)).groupBy(decade.alias("decade")).agg(F.count("*").alias("n"))


@query(_DEGREES + "SELECT id, d AS degree FROM deg ORDER BY d DESC, id LIMIT 30")
def top_hubs(spark, sf):
    return E.degrees(P.edges(spark, sf), P.nodes(spark, sf)).orderBy(F.desc("degree"), "id").limit(30).select("id", "degree")


@query(_DEGREES + f", q AS (SELECT quantile_cont(d, 0.95) AS q95, median(d) AS q50 FROM deg) SELECT {r6('q95')} AS q95, {r6('q50')} AS q50 FROM q")
def degree_quantiles(spark, sf):
    return E.degrees(P.edges(spark, sf), P.nodes(spark, sf)).agg(fixed(F.percentile("degree", F.lit(0.95))).alias("q95"), fixed(F.median("degree")).alias("q50"))


@query(_DEGREES + ", b AS (SELECT min(d) AS lo, max(d) AS hi FROM deg) SELECT least(9, floor((d - lo) * 10 / greatest(hi - lo, 1)))::BIGINT AS bin, count(*) AS n FROM deg, b GROUP BY 1")
def degree_histogram(spark, sf):
    d = E.degrees(P.edges(spark, sf), P.nodes(spark, sf))
    ends = d.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    at = F.least(F.lit(9), F.floor((F.col("degree") - F.col("lo")) * 10 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))))
    return d.crossJoin(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row


@query("SELECT count(*) FILTER (WHERE src = dst) AS self_loops, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS isolates FROM edges")
def loops_and_isolates(spark, sf):
    e, n = P.edges(spark, sf), P.nodes(spark, sf)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return e.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops")).crossJoin(n.join(ends, "id", "left_anti").agg(F.count("*").alias("isolates")))  # one row each


@query(f"SELECT (SELECT count(*) FROM raw_edges) AS raw, count(*) AS kept, (SELECT count(*) FROM raw_edges) - count(*) AS dropped, {r6('count(*)::DOUBLE / (SELECT count(*) FROM nodes)')} AS ratio FROM edges")
def duplicate_accounting(spark, sf):
    raw = P.raw_edges(spark, sf)
    per = raw.groupBy("src", "dst").agg(F.count("*").alias("k")).agg(F.sum("k").alias("raw"), F.count("*").alias("kept"))
    n = P.nodes(spark, sf).agg(F.count("*").alias("n"))
    return per.crossJoin(n).select("raw", "kept", (F.col("raw") - F.col("kept")).alias("dropped"), fixed(F.col("kept") / F.col("n")).alias("ratio"))


# ---- scores


@query(f"SELECT src_community AS community, count(*) AS internal_edges, count(*) FILTER (WHERE reciprocal) AS reciprocal_edges, count(*) FILTER (WHERE typed) AS typed_edges, count(*) FILTER (WHERE intent IN ('Background', 'Perfunctory/Ceremonial')) AS shallow_edges, {r6('avg(weight)')} AS mean_weight, {r6('avg(confidence)')} AS mean_confidence FROM flagged WHERE internal GROUP BY 1")
def internal_edge_stats(spark, sf):
    return S.internal_stats(weighted(spark, sf), P.nodes(spark, sf)).withColumns({c: fixed(F.col(c)) for c in ("mean_weight", "mean_confidence")})


_ASSORT = """, assort AS (
    SELECT community, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-15 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS assortativity
    FROM (SELECT src_community AS community, ln(1 + o.d) AS x, ln(1 + i.d) AS y FROM flagged f JOIN outdeg o ON o.id = f.src JOIN indeg i ON i.id = f.dst WHERE internal) GROUP BY 1
)"""


@query(_ASSORT + f"SELECT community, {r6('assortativity')} AS assortativity FROM assort")
def degree_assortativity(spark, sf):
    return S.degree_assortativity(P.edges(spark, sf), P.nodes(spark, sf)).select("community", fixed(F.col("assortativity")).alias("assortativity"))


_FEATURES = ["density", "log_inflation", "reciprocity", "superficiality", "assortativity", "mean_pagerank_drop"]


def _pagerank_sql(name: str, weight: str = "1.0::DOUBLE", stop: str = "z.n * 1e-6") -> str:
    """A recursive view (id, r) of ranks, iterated until the L1 change is below `stop`."""
    return f""", {name}_arc AS MATERIALIZED (SELECT src, dst, {weight} AS w FROM weighted GROUP BY 1, 2
), {name}_p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM {name}_arc
), {name}_n AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM {name}_p) AS dry, count(*) OVER () AS n FROM nodes
), {name}_all AS (
    SELECT 0 AS k, id, 1.0::DOUBLE / n AS r, NULL::DOUBLE AS was, dry, n FROM {name}_n
    UNION ALL
    SELECT z.k + 1, z.id, 0.15::DOUBLE / z.n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM {name}_all WHERE dry) / z.n), z.r, z.dry, z.n
    FROM {name}_all z LEFT JOIN (SELECT dst, sum(p * r) AS got FROM {name}_p JOIN {name}_all y ON y.id = src GROUP BY 1) g ON g.dst = z.id
    WHERE z.k = 0 OR (SELECT sum(abs(r - was)) FROM {name}_all) >= {stop}
), {name} AS MATERIALIZED (SELECT id, r FROM {name}_all WHERE k = (SELECT max(k) FROM {name}_all))"""


_SHIFTS = _pagerank_sql("pu") + _pagerank_sql("pw", "max(weight)") + f"""
, shifted AS MATERIALIZED (SELECT u.id, u.r AS u, w.r AS w, rank() OVER (ORDER BY {r9('u.r')} DESC) AS place_plain, rank() OVER (ORDER BY {r9('w.r')} DESC) AS place_trust FROM pu u JOIN pw w USING (id))"""
_MEANS = ["mean_pagerank_drop", "mean_rank_drop", "mean_weighted_pagerank", "mean_unweighted_pagerank"]


def _z(f: str) -> str:
    x = r9(f"{f} * (SELECT count(*) FROM edges)") if f == "mean_pagerank_drop" else r9(f)
    return f"CASE WHEN coalesce(stddev_pop({x}) OVER (), 0) > 1e-15 THEN ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () ELSE 0 END"


_CCI = _SHIFTS + _DEGREES + _ASSORT + f""", inner_stats AS (
    SELECT src_community AS community, count(*) AS internal_edges, count(*) FILTER (WHERE reciprocal) AS reciprocal_edges, count(*) FILTER (WHERE typed) AS typed_edges,
        count(*) FILTER (WHERE typed AND intent IN ('Background', 'Perfunctory/Ceremonial')) AS shallow_edges FROM flagged WHERE internal GROUP BY 1
), base AS (SELECT community, count(*) AS size, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, avg(u - w) AS mean_pagerank_drop, avg(place_trust - place_plain) AS mean_rank_drop,
        avg(w) AS mean_weighted_pagerank, avg(u) AS mean_unweighted_pagerank FROM deg LEFT JOIN shifted USING (id) WHERE community IS NOT NULL GROUP BY 1
), feats AS (
    SELECT b.*, coalesce(internal_edges, 0) AS internal_edges, coalesce(reciprocal_edges, 0) AS reciprocal_edges, coalesce(typed_edges, 0) AS typed_edges, coalesce(shallow_edges, 0) AS shallow_edges,
        coalesce(internal_edges, 0) / nullif(size * (size - 1), 0)::DOUBLE AS density0, coalesce(reciprocal_edges / nullif(internal_edges, 0)::DOUBLE, 0) AS reciprocity,
        coalesce(shallow_edges / nullif(typed_edges, 0)::DOUBLE, 0) AS superficiality, coalesce(assortativity, 0) AS assortativity,
        ln(1 + coalesce(internal_edges, 0) / greatest(out_degree::DOUBLE * in_degree / (SELECT count(*) FROM edges), 1e-9)) AS log_inflation,
        coalesce(internal_edges, 0) / greatest(out_degree::DOUBLE * in_degree / (SELECT count(*) FROM edges), 1e-9) AS inflation
    FROM base b LEFT JOIN inner_stats USING (community) LEFT JOIN assort USING (community)
), zs AS (SELECT *, coalesce(density0, 0) AS density FROM feats
), zz AS (SELECT *, {', '.join(f'{_z(f)} AS {f}_z' for f in _FEATURES)} FROM zs
), scored AS MATERIALIZED (SELECT *, {r6('(' + ' + '.join(f'{f}_z' for f in _FEATURES) + ') / 6')} AS cci, {r6('(' + ' + '.join(f'{f}_z' for f in _FEATURES if f != 'superficiality') + ') / 5')} AS structural_cci FROM zz)"""
_COUNTS = ["community", "size", "internal_edges", "reciprocal_edges", "typed_edges", "shallow_edges"]


def scores(spark, sf: str) -> DataFrame:
    e, n = weighted_pairs(spark, sf), P.nodes(spark, sf)
    return S.community_scores(e, n, S.pagerank_shifts(e, n))


@query(_CCI + f"""SELECT {', '.join(_COUNTS)}, {', '.join(f'{r6(f)} AS {f}' for f in _FEATURES[:-1] + ['inflation', 'mean_rank_drop'])}, {', '.join(f'{r6(f + ' * 1e6')} AS {f}_ppm' for f in _MEANS if f != 'mean_rank_drop')},
    {', '.join(f'{r6(f + '_z')} AS {f}_z' for f in _FEATURES)}, cci, structural_cci, rank() OVER (ORDER BY cci DESC) AS cci_rank FROM scored""")
def cci_scores(spark, sf):
    """The composite index of every community from all six features, with the four means of its ranks (in millionths)."""
    return scores(spark, sf).select(
        *_COUNTS, *[fixed(F.col(f)).alias(f) for f in _FEATURES[:-1] + ["inflation", "mean_rank_drop"]], *[fixed(F.col(f) * 1e6).alias(f"{f}_ppm") for f in _MEANS if f != "mean_rank_drop"],
        *[fixed(F.col(f"{f}_z")).alias(f"{f}_z") for f in _FEATURES], "cci", "structural_cci", "cci_rank",
    )


_RANKS = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


def _compared(rows: str, names: dict[str, str]) -> str:
    """Spearman and overlaps of each column of `rows` (community, cci, columns) with cci."""
    top = lambda c, k: f"SELECT community FROM {rows} ORDER BY {c} DESC, community LIMIT {k}"
    pearson = "CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-15 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END"

    def one(name: str, column: str) -> str:
        overlaps = ", ".join(f"(SELECT {r6(f'avg(CASE WHEN community IN ({top(column, k)}) THEN 1.0 ELSE 0.0 END)')} FROM ({top('cci', k)})) AS overlap_{k}" for k in (5, 10, 25))
        return f"SELECT '{name}' AS score, (SELECT {r6(pearson)} FROM (SELECT {_RANKS(column)} AS x, {_RANKS('cci')} AS y FROM {rows})) AS spearman, {overlaps}"

    return " UNION ALL ".join(one(name, column) for name, column in names.items())


_BASELINES = _CCI + f""", fine AS MATERIALIZED (SELECT community, cci, structural_cci, {', '.join(f'{r6(c)} AS {c}' for c in S.BASELINES.values() if c not in ('structural_cci', 'random_score'))},
    CAST(('0x' || substr(md5(community || ':42'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS random_score FROM scored), compared AS ({_compared('fine', S.BASELINES)})"""


@query(_BASELINES + "SELECT * FROM compared")
def spearman_baselines(spark, sf):
    return S.baselines(scores(spark, sf))


@query(_BASELINES + " UNION ALL ".join(f"SELECT score, {k} AS k, overlap_{k} AS precision FROM compared" for k in (5, 10, 25)))
def precision_at_k(spark, sf):
    """Proxy precision of each baseline: a row for each and k."""
    return S.precision_rows(S.baselines(scores(spark, sf)))


_WITHOUT = ", ".join(r6("(" + " + ".join(f"{g}_z" for g in _FEATURES if g != f) + ") / 5") + f" AS without_{f}" for f in _FEATURES)


@query(_CCI + f"SELECT community, cci, {_WITHOUT} FROM scored")
def ablation_scores(spark, sf):
    """The index without each feature."""
    return S.without_each(scores(spark, sf))


@query(_CCI + f", ablated AS MATERIALIZED (SELECT community, cci, {_WITHOUT} FROM scored) " + _compared("ablated", {f: f"without_{f}" for f in _FEATURES}))
def ablation(spark, sf):
    """Spearman and overlaps of the index without each feature against the whole."""
    return S.ablations(scores(spark, sf))


_PRE = """, und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst
), vol AS (SELECT n.community, count(*) AS volume FROM (SELECT a AS id FROM und UNION ALL SELECT b FROM und) JOIN nodes n USING (id) GROUP BY 1
), pre_inner AS (SELECT src_community AS community, count(*) AS internal_edges, count(*) FILTER (WHERE reciprocal) AS reciprocal_edges FROM flagged WHERE internal GROUP BY 1
), pre AS (
    SELECT community, size, coalesce(internal_edges, 0) AS internal_edges, coalesce(reciprocal_edges, 0) AS reciprocal_edges, coalesce(volume, 0) AS volume,
        coalesce(coalesce(internal_edges, 0) / nullif(size * (size - 1), 0)::DOUBLE, 0) AS density, coalesce(reciprocal_edges / nullif(internal_edges, 0)::DOUBLE, 0) AS reciprocity,
        coalesce(volume, 0)::DOUBLE * coalesce(volume, 0) / (2.0::DOUBLE * (SELECT count(*) FROM und)) AS expected
    FROM (SELECT community, count(*) AS size FROM nodes GROUP BY 1) LEFT JOIN pre_inner USING (community) LEFT JOIN vol USING (community))"""


@query(_PRE + f"SELECT community, size, internal_edges, reciprocal_edges, volume, {r6('density')} AS density, {r6('reciprocity')} AS reciprocity, {r6('expected')} AS expected, {r6('internal_edges / greatest(expected, 1e-9)')} AS inflation FROM pre")
def precommunity_scores(spark, sf):
    return S.precommunity_scores(P.edges(spark, sf), P.nodes(spark, sf)).withColumns({c: fixed(F.col(c)) for c in ("density", "reciprocity", "expected", "inflation")})


@query(_PRE + f"SELECT community, {r6(f'({_RANKS('size')}) / count(*) OVER ()')} AS size_pct, {r6(f'({_RANKS('volume')}) / count(*) OVER ()')} AS volume_pct FROM pre")
def pct_rank_scores(spark, sf):
    pre = S.precommunity_scores(P.edges(spark, sf), P.nodes(spark, sf))
    return pre.select("community", fixed(stats.percent_rank("size")).alias("size_pct"), fixed(stats.percent_rank("volume")).alias("volume_pct"))


_TOP = 5  # communities of a kind that a pool takes
_POOLS = _PRE + f""", dense AS (SELECT community FROM pre ORDER BY {r9('density')} DESC, size DESC, community LIMIT {_TOP}
), inflated AS (SELECT community FROM pre ORDER BY {r9('internal_edges / greatest(expected, 1e-9)')} DESC, community LIMIT {_TOP}
), fine_pre AS (SELECT community, {r9('density')} AS density, {r9('internal_edges / greatest(expected, 1e-9)')} AS inflation, {r9('reciprocity')} AS reciprocity FROM pre
), candidates AS (SELECT community FROM (SELECT community, {r6(' + '.join(f"({_RANKS(c)}) / count(*) OVER ()" for c in ('density', 'inflation', 'reciprocity')))} AS rough FROM fine_pre) ORDER BY rough DESC, community LIMIT {_TOP}
), pools AS MATERIALIZED (
    SELECT edge_id, src, dst, 'dense' AS pool FROM flagged WHERE internal AND src_community IN (SELECT community FROM dense)
    UNION ALL SELECT edge_id, src, dst, 'inflated' FROM flagged WHERE internal AND src_community IN (SELECT community FROM inflated)
    UNION ALL SELECT edge_id, src, dst, 'reciprocal' FROM flagged WHERE reciprocal
    UNION ALL SELECT edge_id, src, dst, 'touching' FROM flagged WHERE src_community IN (SELECT community FROM candidates) OR dst_community IN (SELECT community FROM candidates)
    UNION ALL (SELECT edge_id, src, dst, 'random' FROM edges ORDER BY md5(edge_id || ':42'), edge_id LIMIT 2500))"""


def pools(spark, sf) -> DataFrame:
    """(edge_id, src, dst, pool), written: five pools, in each of which an edge stands once. The flagged edges are made once."""
    e, n = P.edges(spark, sf), P.nodes(spark, sf)
    flagged = S.flagged_edges(e, n)
    pre = checkpoint(S.precommunity_scores(flagged, n))
    top = lambda *order: pre.orderBy(*order, "community").limit(_TOP).select("community")
    dense, inflated = top(fixed(F.col("density"), 9).desc(), F.desc("size")), top(fixed(F.col("inflation"), 9).desc())
    inside = lambda t: flagged.filter("internal").join(F.broadcast(t.withColumnRenamed("community", "src_community")), "src_community", "left_semi")  # noqa: E731  five rows
    candidates = S.rough_candidates(pre, _TOP)
    a = F.broadcast(candidates.select(F.col("community").alias("src_community"), F.lit(True).alias("a")))
    b = F.broadcast(candidates.select(F.col("community").alias("dst_community"), F.lit(True).alias("b")))
    touching = flagged.join(a, "src_community", "left").join(b, "dst_community", "left").filter("a or b")
    named = {"dense": inside(dense), "inflated": inside(inflated), "reciprocal": flagged.filter("reciprocal"), "touching": touching, "random": R.sample(flagged, "edge_id", 2500, 42)}
    out = None
    for name, rows in named.items():
        rows = rows.select("edge_id", "src", "dst", F.lit(name).alias("pool"))
        out = rows if out is None else out.unionByName(rows)
    return spill(out, "pools")


@query(_POOLS + "SELECT * FROM pools")
def sampling_pools(spark, sf):
    return pools(spark, sf)


_QUOTAS = {"dense": 250, "inflated": 200, "random": 300, "reciprocal": 150, "touching": 400}


@query(_POOLS + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(edge_id || ':7'), edge_id) AS n FROM pools),
    kept AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY pool) AS k FROM ranked WHERE n <= CASE pool {' '.join(f"WHEN '{p}' THEN {n}" for p, n in _QUOTAS.items())} END)
    SELECT edge_id, src, dst, pool FROM kept WHERE k = 1""")
def quota_selection(spark, sf):
    return R.quota_sample(pools(spark, sf), "edge_id", "pool", _QUOTAS, 7)


@query(_POOLS + """, g1 AS (SELECT edge_id FROM (SELECT DISTINCT edge_id FROM pools WHERE pool = 'dense') ORDER BY md5(edge_id || ':42'), edge_id LIMIT 100
), g2 AS (SELECT edge_id FROM (SELECT DISTINCT edge_id FROM pools WHERE pool = 'reciprocal') WHERE edge_id NOT IN (SELECT edge_id FROM g1) ORDER BY md5(edge_id || ':59'), edge_id LIMIT 100
), g3 AS (SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM g1 UNION SELECT edge_id FROM g2) AND edge_id NOT IN (SELECT edge_id FROM semantics) ORDER BY md5(edge_id || ':143'), edge_id LIMIT 300)
    SELECT edge_id, 'dense' AS selection_group FROM g1 UNION ALL SELECT edge_id, 'reciprocal' FROM g2 UNION ALL SELECT edge_id, 'filler' FROM g3""")
def exclusive_selection(spark, sf):
    p, e = pools(spark, sf), P.edges(spark, sf)
    of = lambda name: p.filter(F.col("pool") == name).select("edge_id").distinct()
    filler = e.join(P.semantics(e), "edge_id", "left_anti")
    return R.exclusive_groups([("dense", of("dense"), 100, 42), ("reciprocal", of("reciprocal"), 100, 59), ("filler", filler, 300, 143)], "edge_id")


_ADAPTIVE = f""", ti AS (SELECT src_community AS community, count(*) AS typed_seen, avg(CASE WHEN intent IN ('Background', 'Perfunctory/Ceremonial') THEN 1.0 ELSE 0.0 END) AS shallow_share, avg(weight) AS seen_weight FROM flagged WHERE internal AND typed GROUP BY 1
), ar AS (SELECT community, size, {r9('density')} AS density, {r9('internal_edges / greatest(expected, 1e-9)')} AS inflation, {r9('reciprocity')} AS reciprocity, {r9('coalesce(shallow_share, 0)')} AS shallow_share,
    {r9('coalesce(seen_weight, (SELECT median(seen_weight) FROM ti), 1.0)')} AS mean_weight, coalesce(typed_seen, 0) AS typed_seen FROM pre LEFT JOIN ti USING (community)
), el AS (SELECT * FROM ar WHERE typed_seen >= 10 OR NOT EXISTS (SELECT 1 FROM ar WHERE typed_seen >= 10)
), rk AS (SELECT community, size, typed_seen, shallow_share, mean_weight, {r6(' + '.join(f"({_RANKS(c)}) / count(*) OVER ()" for c in ('inflation', 'density', 'reciprocity', 'shallow_share')))} AS adaptive_score FROM el
), adaptive AS (SELECT * FROM rk ORDER BY adaptive_score DESC, community LIMIT 10)"""


@query(_PRE + _ADAPTIVE + "SELECT * FROM adaptive")
def adaptive_ranking(spark, sf):
    n, e = P.nodes(spark, sf), P.pairs(spark, sf)
    return S.adaptive_ranking(S.precommunity_scores(e, n), P.semantics(e), n)


@query("SELECT intent, count(*) AS n FROM weighted WHERE typed GROUP BY 1")
def intent_distribution(spark, sf):
    return weighted(spark, sf).filter("typed").groupBy("intent").agg(F.count("*").alias("n"))


@query("SELECT src_community, dst_community, count(*) AS n FROM flagged GROUP BY 1, 2")
def flow_matrix(spark, sf):
    return E.with_communities(P.edges(spark, sf), P.nodes(spark, sf)).groupBy("src_community", "dst_community").agg(F.count("*").alias("n"))


@query("SELECT src_community AS community, intent, count(*) AS n FROM flagged WHERE internal GROUP BY 1, 2")
def intent_breakdown(spark, sf):
    return E.with_communities(weighted(spark, sf), P.nodes(spark, sf)).filter("internal").groupBy(F.col("src_community").alias("community"), "intent").agg(F.count("*").alias("n"))


_SHALLOW = "avg(CASE WHEN intent IN ('Background', 'Perfunctory/Ceremonial') THEN 1.0 ELSE 0.0 END)"


@query(f"SELECT src_community AS community, count(*) AS internal_edges, {r6(_SHALLOW)} AS shallow_share, {_SHALLOW} > 0.6 AS flagged FROM flagged WHERE internal GROUP BY 1 HAVING count(*) > 2")
def shallow_share(spark, sf):
    share = F.avg(L.is_shallow(F.col("intent")).cast("int"))
    inner = E.with_communities(weighted(spark, sf), P.nodes(spark, sf)).filter("internal")
    return inner.groupBy(F.col("src_community").alias("community")).agg(F.count("*").alias("internal_edges"), fixed(share).alias("shallow_share"), (share > 0.6).alias("flagged")).filter("internal_edges > 2")


# ---- labels and text


@query("""
    , shards AS (SELECT edge_id, intent, 1 AS priority, 'a' AS source, src AS pos FROM semantics UNION ALL SELECT edge_id, 'Support', 1, 'b', dst FROM semantics WHERE src % 3 = 0 UNION ALL SELECT edge_id, 'Method', 1, 'b', dst + 1 FROM semantics WHERE src % 6 = 0
        UNION ALL SELECT edge_id, 'Support', 2, 'a', 0 FROM semantics WHERE confidence < 0.5 UNION ALL SELECT edge_id, 'Method', 10000, 'teacher', 0 FROM semantics WHERE confidence > 0.9)
    SELECT edge_id, intent, priority, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY priority DESC, source DESC, pos DESC) AS n FROM shards) WHERE n = 1""")
def priority_dedup(spark, sf):
    """Of the labels of an edge the one of largest priority, then the last source, then the last place."""
    s = P.semantics(P.edges(spark, sf))
    shard = lambda where, intent, priority, source, pos: s.filter(where).select("edge_id", intent.alias("intent"), F.lit(priority).alias("priority"), F.lit(source).alias("source"), F.expr(pos).cast("long").alias("pos"))
    named = [("true", F.col("intent"), 1, "a", "src"), ("src % 3 = 0", F.lit("Support"), 1, "b", "dst"), ("src % 6 = 0", F.lit("Method"), 1, "b", "dst + 1"), ("confidence < 0.5", F.lit("Support"), 2, "a", "0"), ("confidence > 0.9", F.lit("Method"), 10000, "teacher", "0")]
    shards = None
    for one in named:
        shards = shard(*one) if shards is None else shards.unionByName(shard(*one))
    return R.keep_first(shards, "edge_id", F.desc("priority"), F.desc("source"), F.desc("pos"))


#: Replies of a labelling service, well and badly formed, for event_id % 13.
_REPLIES = (
    '{"label":"method","confidence":0.9}', '{"label":"This is Support","confidence":"1.7"}', '{"label":"Background or Method","confidence":null}', '{"label":"other"}', None, 'not json',
    '{"label": "Support", "confidence": 0.5', '["Method"]', '{"label":"CONTRAST/criticism","confidence":-3}', '{"label":" result/comparison ","confidence":"NaN"}', '{"confidence":0.4}', '{"label":7,"confidence":true}', '{"label":"Perfunctory/Ceremonial","confidence":"high"}',
)
_REPLY = "CASE event_id % 13 " + " ".join(f"WHEN {k} THEN {'NULL' if r is None else repr(r)}" for k, r in enumerate(_REPLIES)) + " END"
_INTENT_SQL = ("Background", "Method", "Result/Comparison", "Support", "Contrast/Criticism", "Perfunctory/Ceremonial")
_PARSED = f"""parsed AS (
    SELECT *, CASE WHEN json_valid(content) THEN coalesce(json_extract_string(content, '$.label'), '') END AS raw, CASE WHEN json_valid(content) THEN try_cast(json_extract_string(content, '$.confidence') AS DOUBLE) END AS c FROM replies
), named AS (
    SELECT *, coalesce({', '.join(f"CASE WHEN lower(trim(raw)) = '{x.lower()}' THEN '{x}' END" for x in _INTENT_SQL)}, {', '.join(f"CASE WHEN contains(lower(trim(raw)), '{x.lower()}') THEN '{x}' END" for x in _INTENT_SQL)}) AS label FROM parsed
), labelled AS (
    SELECT * EXCLUDE (label, raw, c, content), label, CASE WHEN label IS NOT NULL AND c IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) END AS confidence,
        CASE WHEN content IS NULL THEN 'missing_message_content' WHEN NOT json_valid(content) THEN 'json_decode_error' WHEN label IS NULL THEN 'unknown_label: ' || raw END AS error FROM named)"""


@query(f"WITH replies AS (SELECT event_id, {_REPLY} AS content FROM events), {_PARSED} SELECT event_id, label, confidence, error FROM labelled", views=False)
def label_parse(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_REPLY).alias("content"))
    return rows.select("event_id", L.parse_reply(F.col("content")).alias("r")).select("event_id", "r.*")


_LABELS = "labelled AS (SELECT intent AS label, confidence FROM semantics WHERE intent <> 'Support' AND (intent <> 'Method' OR src % 97 = 0))"


@query(f""", {_LABELS}, names AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{x}')" for k, x in enumerate(_INTENT_SQL))}) t(k, label)
), c AS (SELECT label, k, coalesce(n, 0) AS n FROM names LEFT JOIN (SELECT label, count(*) AS n FROM labelled GROUP BY 1) USING (label))
    SELECT label, n, floor(n * 10000.0::DOUBLE / (SELECT count(*) FROM labelled) + 0.5) / 10000.0::DOUBLE AS share, n = 0 AS missing, n > 0 AND n < 100 AS underpowered, (SELECT count(*) = 0 FROM c WHERE n < 100) AS ready,
        (SELECT count(*) FROM labelled) AS rows, {', '.join(f"(SELECT {r6(f'{f}(confidence)')} FROM labelled) AS confidence_{f2}" for f, f2 in (('avg', 'mean'), ('median', 'median'), ('min', 'min'), ('max', 'max')))} FROM c""")
def label_audit(spark, sf):
    """Counts of all six labels, one of which is missing here and one weak, with confidences and whether a student can be trained."""
    s = P.semantics(P.pairs(spark, sf)).filter("intent <> 'Support' and (intent <> 'Method' or src % 97 = 0)")
    return L.audit(s.select(F.col("intent").alias("label"), "confidence"), 100)


@query(f"SELECT quality AS label, {r6('sum(count(*)) OVER () / (count(*) OVER () * greatest(count(*), 1))::DOUBLE')} AS weight FROM labels GROUP BY 1", views=False)
def class_weights(spark, sf):
    counts = table(spark, sf, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select("label", fixed(F.sum("n").over(every) / (F.count("*").over(every) * F.greatest("n", F.lit(1)))).alias("weight"))


_PRED = "SELECT label AS gold, CASE WHEN embedding[1] > 0.1 THEN (label + 1) % 10 ELSE label END AS pred FROM embeddings"


def predictions(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("label").alias("gold"), F.when(F.element_at("embedding", 1) > 0.1, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("pred"))


@query("WITH p AS (" + _PRED + ") SELECT gold, " + ", ".join(f"count(*) FILTER (WHERE pred = {k}) AS p{k}" for k in range(10)) + " FROM p GROUP BY 1", views=False)
def confusion_matrix(spark, sf):
    wide = predictions(spark, sf).groupBy("gold").pivot("pred", list(range(10))).agg(F.count(F.lit(1)))
    return wide.select("gold", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias(f"p{k}") for k in range(10)])


@query(f"""
    WITH p AS ({_PRED}), c AS (SELECT k.gold AS label, (SELECT count(*) FROM p WHERE gold = k.gold AND pred = k.gold) AS hit, (SELECT count(*) FROM p WHERE gold = k.gold) AS support, (SELECT count(*) FROM p WHERE pred = k.gold) AS said FROM (SELECT DISTINCT gold FROM p) k)
    SELECT label, support, {r6('coalesce(hit / nullif(said, 0)::DOUBLE, 0)')} AS prec, {r6('hit / support::DOUBLE')} AS recall, {r6('coalesce(2.0 * hit / nullif(said + support, 0)::DOUBLE, 0)')} AS f1,
        {r6('sum(hit) OVER () / sum(support) OVER ()::DOUBLE')} AS accuracy, {r6('avg(coalesce(2.0 * hit / nullif(said + support, 0)::DOUBLE, 0)) OVER ()')} AS macro_f1,
        {r6('sum(support * coalesce(2.0 * hit / nullif(said + support, 0)::DOUBLE, 0)) OVER () / sum(support) OVER ()')} AS weighted_f1 FROM c""", views=False)
def class_report(spark, sf):
    p = predictions(spark, sf)
    cells = p.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    gold = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("hit"))
    said = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    every, s = Window.partitionBy(), F.coalesce("said", F.lit(0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), s + F.col("support")), F.lit(0.0))
    return gold.join(said, "label", "left").select(
        "label", "support", fixed(F.coalesce(F.try_divide("hit", s), F.lit(0.0))).alias("prec"), fixed(F.col("hit") / F.col("support")).alias("recall"),
        fixed(f1).alias("f1"), fixed(F.sum("hit").over(every) / F.sum("support").over(every)).alias("accuracy"), fixed(F.avg(f1).over(every)).alias("macro_f1"),
        fixed(F.sum(F.col("support") * f1).over(every) / F.sum("support").over(every)).alias("weighted_f1"),
    )


_STOP = "['the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was', 'were', 'using', 'based', 'paper', 'method', 'approach', 'results', 'data', 'model', 'models', 'study']"
_TOK = lambda c: f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9_+-]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))))"


@query(f"""
    WITH t AS (SELECT item_id, {_TOK('text')} AS t FROM benchmark)
    SELECT a.item_id, len(a.t) AS n_tokens, {r6("CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END")} AS jaccard
    FROM t a JOIN t b ON b.item_id = a.item_id + 1""", views=False)
def jaccard_pairs(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(b, "item_id").select("item_id", F.size("t").cast("long").alias("n_tokens"), fixed(text.jaccard(F.col("t"), F.col("u"))).alias("jaccard"))


@query("""
    WITH w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark
    ), cells AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w
    ), put AS (SELECT item_id, word, i + i // 7 + item_id % 3 AS pos, i AS n FROM cells UNION ALL SELECT item_id, word || '!', i + i // 7 + item_id % 3, i + 10000 FROM cells WHERE i % 11 = 0
    ), last AS (SELECT item_id, pos, arg_max(word, n) AS word FROM put GROUP BY 1, 2
    ), size AS (SELECT item_id, max(pos) + 1 + CASE WHEN item_id % 2 = 0 THEN 3 ELSE 0 END AS n FROM put GROUP BY 1
    ), filled AS (SELECT s.item_id, string_agg(coalesce(word, ''), ' ' ORDER BY p) AS text FROM (SELECT item_id, unnest(range(n)) AS p FROM size) s LEFT JOIN last l ON l.item_id = s.item_id AND l.pos = s.p GROUP BY 1)
    SELECT item_id, trim(text) AS text FROM filled""", views=False)
def inverted_index_text(spark, sf):
    """Texts from indexes with gaps (every seventh place and the first ones), repeats (a later word at a taken place) and lengths beyond the last word."""
    place = lambda i: (i + F.floor(i / 7) + F.pmod("item_id", F.lit(3))).cast("int")
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), place(i).alias("pos")))
    again = F.transform(F.filter(F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["i"] % 11 == 0), lambda x: F.struct(F.concat(x["w"], F.lit("!")).alias("word"), place(x["i"]).alias("pos")))
    rows = table(spark, sf, "benchmark").select("item_id", F.concat(words, again).alias("words"))
    last = F.array_max(F.transform("words", lambda w: w["pos"])) + 1
    return rows.select("item_id", text.text_from_index(F.col("words"), F.when(F.col("item_id") % 2 == 0, last + 3).otherwise(last)).alias("text"))


@query("SELECT o_orderkey, coalesce(arg_max(l_returnflag, (l_quantity, -l_linenumber)), 'Unknown') AS top FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY 1", views=False)
def top_field(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("name"), F.max("l_quantity").alias("w"))
    fields = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "name", "w"))).alias("fields"))
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.join(fields, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", text.top_field(F.col("fields")).alias("top"))


@query("SELECT doc_id, substring(concat(coalesce(source, ''), ' ', coalesce(text, '')), 1, 1200) AS clipped, concat(coalesce(source, ''), '. ', coalesce(text, '')) AS pair_text FROM documents", views=False)
def pair_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.clipped(F.col("source"), F.col("text")).alias("clipped"), text.pair_text(F.col("source"), F.col("text")).alias("pair_text"))


@query(f"SELECT role, count(*) AS requests, sum(length(text))::BIGINT AS chars, {r6('count(*) * (1500 * 0.20::DOUBLE + 30 * 0.80::DOUBLE) / 1000000')} AS cost, count(*) * (1500 * 0.20::DOUBLE + 30 * 0.80::DOUBLE) / 1000000 > 0.08::DOUBLE AS over_cap FROM conversations GROUP BY 1", views=False)
def cost_estimate(spark, sf):
    """What requests cost by tokens and prices of either way, and whether that is above a cap."""
    prices = Prices(1500, 30, 0.20, 0.80)
    n = F.count("*")
    return table(spark, sf, "conversations").groupBy("role").agg(n.alias("requests"), F.sum(F.length("text")).alias("chars"), fixed(prices.cost(n)).alias("cost"), (prices.cost(n) > 0.08).alias("over_cap"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || ':5'), doc_id) AS n, count(*) OVER (PARTITION BY quality) AS c FROM labels)
    SELECT doc_id, quality, CASE WHEN (n - 1) / c::DOUBLE < 0.8 THEN 'train' WHEN (n - 1) / c::DOUBLE < 0.9 THEN 'valid' ELSE 'test' END AS part FROM r""", views=False)
def stratified_split(spark, sf):
    return R.stratified_split(table(spark, sf, "labels"), "doc_id", "quality", 5, (("train", 0.8), ("valid", 0.1), ("test", 0.1))).select("doc_id", "quality", "part")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || ':9'), doc_id) AS n, count(*) OVER (PARTITION BY quality) AS c, count(*) OVER () AS t FROM labels)
    SELECT doc_id, quality FROM r WHERE n <= greatest(1, floor(c * 100 / t::DOUBLE + 0.5))""", views=False)
def stratified_cap(spark, sf):
    return R.stratified_cap(table(spark, sf, "labels"), "doc_id", "quality", 100, 9).select("doc_id", "quality")


_CHUNKS = """
    WITH RECURSIVE t AS (SELECT conv_id * 100000 + turn AS request, octet_length(encode(text))::BIGINT AS bytes FROM conversations
    ), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY request, bytes) AS n FROM t
    ), walk AS (
        SELECT n, request, bytes, 0::BIGINT AS chunk, 1 AS held, bytes AS sum FROM o WHERE n = 1
        UNION ALL
        SELECT o.n, o.request, o.bytes, CASE WHEN held >= 50 OR sum + o.bytes > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN held >= 50 OR sum + o.bytes > 20000 THEN 1 ELSE held + 1 END,
            CASE WHEN held >= 50 OR sum + o.bytes > 20000 THEN o.bytes ELSE sum + o.bytes END FROM walk w JOIN o ON o.n = w.n + 1
    ) SELECT request, bytes, chunk FROM walk"""


@query(_CHUNKS, views=False)
def request_chunks(spark, sf):
    """Greedy chunks of conversation turns by rows and bytes."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("request"), F.octet_length("text").cast("long").alias("bytes"))
    return R.chunks(t, "request", "bytes", 50, 20_000)


# ---- graph


def _pagerank_k_sql(k: int, name: str) -> str:
    parts = [f", {name}_p AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS p FROM edges)", f"{name}_0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(1, k + 1):
        parts.append(f"{name}_{i} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM {name}_{i - 1} WHERE id NOT IN (SELECT src FROM {name}_p)) / (SELECT count(*) FROM nodes)) AS r FROM nodes n LEFT JOIN (SELECT dst, sum(p * r) AS got FROM {name}_p JOIN {name}_{i - 1} z ON z.id = src GROUP BY 1) g ON g.dst = n.id)")
    return ", ".join(parts)


@query(_pagerank_k_sql(5, "pr") + f"SELECT id, {r9('r')} AS rank FROM pr_5")
def pagerank_k(spark, sf):
    """Five rounds, whatever the change."""
    return G.pagerank(P.pairs(spark, sf), P.nodes(spark, sf), rounds=5, stop="fixed").select("id", fixed(F.col("rank"), 9).alias("rank"))


@query(_pagerank_sql("pr") + f"SELECT id, {r9('r')} AS rank FROM pr")
def pagerank(spark, sf):
    """Until the L1 change is below a millionth of the number of nodes."""
    return G.pagerank(P.pairs(spark, sf), P.nodes(spark, sf)).select("id", fixed(F.col("rank"), 9).alias("rank"))


@query(_pagerank_sql("pu", stop="1e-9") + _pagerank_sql("pw", "max(weight)", stop="1e-9") + f"SELECT u.id, {r9('u.r')} AS rank_plain, {r9('w.r')} AS rank_trust FROM pu u JOIN pw w USING (id)")
def pagerank_stationary(spark, sf):
    """Both variants until the L1 change is below 1e-9: ranks that no further round would change."""
    both = G.pageranks(weighted_pairs(spark, sf), P.nodes(spark, sf), {"rank_plain": None, "rank_trust": "weight"}, tol=1e-9, stop="l1")
    return both.select("id", *[fixed(F.col(c), 9).alias(c) for c in ("rank_plain", "rank_trust")])


@query(_SHIFTS + f"SELECT id, title, domain, {r9('u')} AS rank_plain, {r9('w')} AS rank_trust, {r9('(u - w) * 1000')} AS drop_permille, place_plain, place_trust, place_trust - place_plain AS rank_drop FROM shifted JOIN nodes USING (id)")
def trust_pagerank_shift(spark, sf):
    """Ranks without and with weights, to convergence, with the drop in value and in places and the node's metadata."""
    n = P.nodes(spark, sf)
    rows = S.pagerank_shifts(weighted_pairs(spark, sf), n).join(n.select("id", "title", "domain"), "id", "left")
    return rows.select("id", "title", "domain", *[fixed(F.col(c), 9).alias(c) for c in ("rank_plain", "rank_trust")], fixed(F.col("drop") * 1000, 9).alias("drop_permille"), "place_plain", "place_trust", "rank_drop")


@query(_SHIFTS + ", places AS (SELECT id, title, domain, place_trust - place_plain AS rank_drop FROM shifted JOIN nodes USING (id))"
       " (SELECT 'drop' AS kind, * FROM places ORDER BY rank_drop DESC, id LIMIT 25) UNION ALL (SELECT 'gain', * FROM places ORDER BY rank_drop, id LIMIT 25)")  # fmt: skip
def shift_extremes(spark, sf):
    """The 25 largest drops and gains of places, with metadata."""
    n = P.nodes(spark, sf)
    return S.shift_extremes(S.pagerank_shifts(weighted_pairs(spark, sf), n), n, ["title", "year", "n_citation", "domain"]).drop("drop")


def components_sql(name: str, arcs: str) -> str:
    """A recursive view (key, id, component) from arcs (key, src, dst), which stand in both directions: the least node reached, until none changes."""
    return f""", {name}_all AS (
    SELECT 0 AS k, key, src AS id, src AS c, NULL::BIGINT AS was FROM (SELECT DISTINCT key, src FROM {arcs})
    UNION ALL
    SELECT z.k + 1, z.key, z.id, least(z.c, g.m), z.c FROM {name}_all z JOIN (SELECT a.key, a.dst AS id, min(y.c) AS m FROM {arcs} a JOIN {name}_all y ON y.key = a.key AND y.id = a.src GROUP BY 1, 2) g ON g.key = z.key AND g.id = z.id
    WHERE z.k = 0 OR EXISTS (SELECT 1 FROM {name}_all WHERE c <> was)
), {name} AS MATERIALIZED (SELECT key, id, c AS component FROM {name}_all WHERE k = (SELECT max(k) FROM {name}_all))"""


def bfs_sql(name: str, arcs: str, starts: str) -> str:
    """A recursive view (key, source, id, d) of all nodes reached from starts (key, id) over arcs (key, src, dst)."""
    return f""", {name}_all AS (
    SELECT 0 AS k, key, id AS source, id, 0 AS d, 0 AS n FROM {starts}
    UNION ALL
    SELECT k, key, source, id, min(d), any_value(n) FROM (
        SELECT k + 1 AS k, key, source, id, d, (SELECT count(*) FROM {name}_all) AS n FROM {name}_all
        UNION ALL SELECT y.k + 1, y.key, y.source, a.dst, y.d + 1, (SELECT count(*) FROM {name}_all) FROM {name}_all y JOIN {arcs} a ON a.key = y.key AND a.src = y.id
    ) WHERE (SELECT max(n) FROM {name}_all) < (SELECT count(*) FROM {name}_all) GROUP BY 1, 2, 3, 4
), {name} AS MATERIALIZED (SELECT key, source, id, d FROM {name}_all WHERE k = (SELECT max(k) FROM {name}_all))"""


_ARCS = ", both_ways AS MATERIALIZED (SELECT 0 AS key, src, dst FROM edges WHERE src <> dst UNION SELECT 0, dst, src FROM edges WHERE src <> dst)"


@query(_ARCS + components_sql("parts", "both_ways") + "SELECT id, component FROM parts")
def components(spark, sf):
    return connected_components(P.pairs(spark, sf)).withColumnRenamed("node", "id")


@query(", sparse AS MATERIALIZED (SELECT 0 AS key, src, dst FROM edges WHERE src <> dst AND (src + dst) % 23 = 0 UNION SELECT 0, dst, src FROM edges WHERE src <> dst AND (src + dst) % 23 = 0)"
       + components_sql("parts", "sparse") + "SELECT id, component FROM parts")
def components_sparse(spark, sf):
    """Components of the links whose ends sum to a multiple of 23: many, of all sizes."""
    return connected_components(P.pairs(spark, sf).filter("(src + dst) % 23 = 0")).withColumnRenamed("node", "id")


_BFS = """, arcs AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst
), starts AS (SELECT id FROM nodes ORDER BY md5(id::VARCHAR || ':3'), id LIMIT 8
), l0 AS (SELECT id AS source, id, 0 AS distance FROM starts
)""" + "".join(f", l{k} AS MATERIALIZED (SELECT source, id, min(distance)::INTEGER AS distance FROM (SELECT * FROM l{k - 1} UNION ALL SELECT l.source, a.dst, {k} FROM l{k - 1} l JOIN arcs a ON a.src = l.id) GROUP BY 1, 2)" for k in range(1, 7))  # fmt: skip


def _levels(spark, sf) -> DataFrame:
    return G.bfs(P.pairs(spark, sf), R.sample(P.nodes(spark, sf), "id", 8, 3))


@query(_BFS + "SELECT source, id, distance FROM l6")
def bfs_levels(spark, sf):
    return _levels(spark, sf)


@query(_BFS + f"SELECT {r6('avg(distance) FILTER (WHERE distance > 0)')} AS mean_path, {r6('avg(distance)')} AS mean_with_self, max(distance) AS eccentricity, count(*) AS reached FROM l6")
def path_means(spark, sf):
    d = F.col("distance")
    return _levels(spark, sf).agg(fixed(F.avg(F.when(d > 0, d))).alias("mean_path"), fixed(F.avg(d)).alias("mean_with_self"), F.max(d).alias("eccentricity"), F.count("*").alias("reached"))


_UND = ", und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)"


@query(_UND + f""", deg2 AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM und UNION ALL SELECT b FROM und) GROUP BY 1),
    tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM und x JOIN und y ON y.a = x.b JOIN und z ON z.a = x.a AND z.b = y.b),
    t AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY 1)
    SELECT n.id, coalesce(t, 0) AS triangles, coalesce(d, 0) AS degree, {r6('CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END')} AS clustering FROM nodes n LEFT JOIN deg2 USING (id) LEFT JOIN t USING (id)""")
def clustering(spark, sf):
    return G.local_clustering(P.edges(spark, sf), P.nodes(spark, sf)).withColumn("clustering", fixed(F.col("clustering")))


@query(_UND + f""", ends AS (SELECT n.community AS c, count(*) AS vol FROM (SELECT a AS id FROM und UNION ALL SELECT b FROM und) JOIN nodes n USING (id) GROUP BY 1),
    ins AS (SELECT x.community AS c, count(*) AS k FROM und JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE x.community = y.community GROUP BY 1), m AS (SELECT count(*) AS m FROM und)
    SELECT {r6('sum(coalesce(k, 0) / m::DOUBLE - (vol / (2.0::DOUBLE * m)) ** 2)')} AS modularity FROM ends LEFT JOIN ins USING (c), m""")
def modularity(spark, sf):
    return G.modularity(P.edges(spark, sf), P.nodes(spark, sf)).select(fixed(F.col("modularity")).alias("modularity"))


@query(f""", j AS (SELECT domain, community, count(*)::DOUBLE AS n FROM nodes GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j),
    a AS (SELECT domain, sum(n) AS n FROM j GROUP BY 1), b AS (SELECT community, sum(n) AS n FROM j GROUP BY 1),
    mi AS (SELECT sum(j.n / t * ln(j.n * t / (a.n * b.n))) AS mi FROM j JOIN a USING (domain) JOIN b USING (community), t), h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb)
    SELECT {r6('mi / ((ha + hb) / 2)')} AS nmi FROM mi, h""")
def nmi(spark, sf):
    j = P.nodes(spark, sf).groupBy("domain", "community").agg(F.count("*").cast("double").alias("n"))
    every = Window.partitionBy()
    j = j.withColumns({"t": F.sum("n").over(every), "a": F.sum("n").over(Window.partitionBy("domain")), "b": F.sum("n").over(Window.partitionBy("community"))})
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b"))))
    entropy = lambda c: -F.sum(F.col("n") / F.col("t") * F.log(F.col(c) / F.col("t")))
    return j.agg(fixed(F.coalesce(F.try_divide(mi, (entropy("a") + entropy("b")) / 2.0), F.lit(0.0))).alias("nmi"))


@query(_UND + f""", deg2 AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM und UNION ALL SELECT b FROM und) GROUP BY 1),
    nb AS (SELECT x.id, avg(y.d) AS m FROM (SELECT a AS id, b AS o FROM und UNION ALL SELECT b, a FROM und) x JOIN deg2 y ON y.id = x.o GROUP BY 1)
    SELECT d AS degree, count(*) AS n, {r6('avg(m)')} AS mean_neighbour_degree FROM deg2 JOIN nb USING (id) GROUP BY 1""")
def knn_by_degree(spark, sf):
    pairs = E.undirected(P.edges(spark, sf))
    both = pairs.selectExpr("a id", "b other").unionByName(pairs.selectExpr("b id", "a other"))
    degree = both.groupBy("id").agg(F.count("*").alias("degree"))
    near = both.join(degree.selectExpr("id other", "degree d"), "other").groupBy("id").agg(F.avg("d").alias("m"))
    return degree.join(near, "id").groupBy("degree").agg(F.count("*").alias("n"), fixed(F.avg("m")).alias("mean_neighbour_degree"))


_TRIM = _DEGREES + """, t0 AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 300)""" + "".join(
    f", t{k} AS MATERIALIZED (SELECT id FROM t{k - 1} WHERE id IN (SELECT src FROM edges WHERE src IN (SELECT id FROM t{k - 1}) AND dst IN (SELECT id FROM t{k - 1}) UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM t{k - 1}) AND dst IN (SELECT id FROM t{k - 1})))" for k in range(1, 6))


@query(_TRIM + "SELECT id FROM t5")
def trim_top_degree(spark, sf):
    return G.trim_to(P.edges(spark, sf), P.nodes(spark, sf), 300)


_HEALTH_SOURCES, _CONTROL_SEEDS = 32, (11, 23, 37, 42, 101)


def _health_sql(scenarios: str) -> str:
    """Views that end in health(key, ...) from scenario_pairs (key, a, b), which hold loops, and a seed for each key."""
    return f""", scenario_pairs AS MATERIALIZED ({scenarios}
), arcs AS MATERIALIZED (SELECT key, a AS src, b AS dst FROM scenario_pairs WHERE a <> b UNION ALL SELECT key, b, a FROM scenario_pairs WHERE a <> b)""" + components_sql("parts", "arcs") + f"""
, sizes AS (SELECT key, component, count(*) AS n FROM parts GROUP BY 1, 2
), giant AS MATERIALIZED (SELECT key, component, n, (SELECT count(*) FROM sizes s WHERE s.key = g.key) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, component) AS p FROM sizes) g WHERE p = 1
), starts AS MATERIALIZED (SELECT key, id FROM (SELECT p.key, p.id, row_number() OVER (PARTITION BY p.key ORDER BY md5(p.id::VARCHAR || ':' || c.seed), p.id) AS n FROM parts p JOIN giant USING (key, component) JOIN scenarios c USING (key)) WHERE n <= {_HEALTH_SOURCES}
)""" + bfs_sql("far", "arcs", "starts") + f"""
, paths AS (SELECT key, avg(d) AS m FROM far WHERE d > 0 GROUP BY 1
), health AS (
    SELECT c.key, (SELECT count(*) FROM nodes) AS n_nodes, coalesce(e.n, 0) AS n_pairs, coalesce(g.parts, 0) + (SELECT count(*) FROM nodes) - (SELECT count(*) FROM parts p WHERE p.key = c.key) AS components,
        coalesce(g.n, 1) AS giant, {r6('coalesce(g.n, 1)::DOUBLE / (SELECT count(*) FROM nodes)')} AS giant_share, {r6('coalesce(h.m, 0)')} AS mean_path
    FROM scenarios c LEFT JOIN (SELECT key, count(*) AS n FROM scenario_pairs GROUP BY 1) e USING (key) LEFT JOIN giant g USING (key) LEFT JOIN paths h USING (key))"""


@query(", scenarios AS (SELECT 0 AS key, 42 AS seed)" + _health_sql("SELECT DISTINCT 0 AS key, least(src, dst) AS a, greatest(src, dst) AS b FROM edges") + "SELECT * EXCLUDE (key) FROM health")
def graph_health(spark, sf):
    """Nodes, pairs, components, the giant's share and its mean path from 32 sampled nodes."""
    pairs = P.pairs(spark, sf).select(F.lit(0).alias("key"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return C.graph_health(pairs, P.nodes(spark, sf), {0: 42}, _HEALTH_SOURCES).drop("key")


_EXCISION = _CCI + f""", worst AS (SELECT community FROM scored ORDER BY cci DESC, community LIMIT 5
), gone AS MATERIALIZED (SELECT src, dst FROM flagged WHERE internal AND src_community IN (SELECT community FROM worst)
), whole AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges
), scenarios AS MATERIALIZED (SELECT * FROM (VALUES (0, 'baseline', {_CONTROL_SEEDS[0]}), (1, 'index_top', {_CONTROL_SEEDS[0]}), {', '.join(f"({k}, 'random_matched', {seed})" for k, seed in enumerate(_CONTROL_SEEDS, 2))}) t(key, strategy, seed)
), drawn AS MATERIALIZED (SELECT key, a, b FROM (SELECT c.key, a, b, row_number() OVER (PARTITION BY c.key ORDER BY md5(a || '-' || b || ':' || c.seed), a, b) AS n FROM whole, scenarios c WHERE c.key > 1) WHERE n <= (SELECT count(*) FROM gone)
)""" + _health_sql("""SELECT 0 AS key, a, b FROM whole
    UNION ALL SELECT 1, a, b FROM whole ANTI JOIN (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM gone) USING (a, b)
    UNION ALL SELECT c.key, w.a, w.b FROM whole w CROSS JOIN (SELECT key FROM scenarios WHERE key > 1) c ANTI JOIN drawn d ON d.key = c.key AND d.a = w.a AND d.b = w.b""")


@query(_EXCISION + "SELECT strategy, CASE WHEN key > 1 THEN seed END AS seed, CASE WHEN key = 0 THEN 0 WHEN key = 1 THEN (SELECT count(*) FROM gone) ELSE least((SELECT count(*) FROM gone), (SELECT count(*) FROM whole)) END AS removed_edges, health.* EXCLUDE (key) FROM health JOIN scenarios USING (key)")
def excision(spark, sf):
    """Health of the graph, of it without the internal edges of the five communities of largest index, and without as many random pairs, for five seeds."""
    e, n = weighted_pairs(spark, sf), P.nodes(spark, sf)
    return C.excision(e, n, S.community_scores(e, n, S.pagerank_shifts(e, n)), _CONTROL_SEEDS, _HEALTH_SOURCES)


def _reach_sql(name: str, arcs: str, start: str) -> str:
    return f", {name} AS (SELECT id FROM {start} UNION SELECT {arcs} JOIN {name} y ON y.id = near)"


@query(f""", step AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst
), fore AS (SELECT id AS source, id FROM nodes UNION SELECT f.source, s.dst FROM fore f JOIN step s ON s.src = f.id
), strong AS MATERIALIZED (SELECT a.source AS id, min(a.id) AS component FROM fore a JOIN fore b ON b.source = a.id AND b.id = a.source GROUP BY 1)
    SELECT id, component FROM strong""")
def strong_components(spark, sf):
    return G.strong_components(P.pairs(spark, sf), P.nodes(spark, sf))


_SPARSE = "FROM edges WHERE src <> dst AND (src * 31 + dst * 17) % 29 = 0"
_STRONG = f""", step AS MATERIALIZED (SELECT DISTINCT src, dst {_SPARSE}
), fore AS (SELECT id AS source, id FROM nodes UNION SELECT f.source, s.dst FROM fore f JOIN step s ON s.src = f.id
), strong AS MATERIALIZED (SELECT a.source AS id, min(a.id) AS component FROM fore a JOIN fore b ON b.source = a.id AND b.id = a.source GROUP BY 1)"""


@query(_STRONG + "SELECT id, component FROM strong")
def strong_components_sparse(spark, sf):
    """Of about one edge in 29: many components."""
    return G.strong_components(P.pairs(spark, sf).filter("(src * 31 + dst * 17) % 29 = 0"), P.nodes(spark, sf))


def _bow_tie_sql(strong: str) -> str:
    return strong + """, core AS MATERIALIZED (SELECT id FROM strong WHERE component = (SELECT component FROM strong GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
), ahead AS (SELECT DISTINCT id FROM fore WHERE source IN (SELECT id FROM core)), behind AS (SELECT DISTINCT source AS id FROM fore WHERE id IN (SELECT id FROM core)
), both_ways AS MATERIALIZED (SELECT 0 AS key, src, dst FROM step UNION SELECT 0, dst, src FROM step)""" + components_sql("weak", "both_ways") + """
, near AS (SELECT id FROM weak WHERE component = (SELECT component FROM weak GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1))
    SELECT CASE WHEN id IN (SELECT id FROM core) THEN 'core' WHEN id IN (SELECT id FROM behind) THEN 'in' WHEN id IN (SELECT id FROM ahead) THEN 'out' WHEN id IN (SELECT id FROM near) THEN 'tendril' ELSE 'apart' END AS part, count(*) AS n
    FROM nodes GROUP BY 1"""


@query(_bow_tie_sql(_STRONG))
def bow_tie(spark, sf):
    """How many nodes are in each part, of the graph of about one edge in 29 (the whole one is all core)."""
    return G.bow_tie(P.pairs(spark, sf).filter("(src * 31 + dst * 17) % 29 = 0"), P.nodes(spark, sf)).groupBy("part").agg(F.count("*").alias("n"))


def _snowball_sql(budget: int, seed: int, levels: int = 12) -> str:
    """Levels one by one; few are needed, as a level holds all neighbours."""
    parts = ", links AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s0 AS (SELECT id, 0 AS level FROM (SELECT id FROM deg ORDER BY i DESC, id LIMIT 5))"
    for k in range(1, levels + 1):
        parts += f""", s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL (SELECT id, {k} FROM (SELECT DISTINCT dst AS id FROM links WHERE src IN (SELECT id FROM s{k - 1} WHERE level = {k - 1}) AND dst NOT IN (SELECT id FROM s{k - 1}))
        ORDER BY md5(id::VARCHAR || ':{seed}'), id LIMIT (SELECT {budget} - count(*) FROM s{k - 1})))"""
    return parts + f" SELECT id, level FROM s{levels}"


@query(_DEGREES + _snowball_sql(500, 42))
def snowball_sample(spark, sf):
    e, n = P.pairs(spark, sf), P.nodes(spark, sf)
    seeds = E.degrees(e, n).orderBy(F.desc("in_degree"), "id").limit(5)
    return G.snowball(e, seeds, 500, 42)


@query()
def louvain_communities(spark, sf):
    return G.label_moves(P.pairs(spark, sf), P.nodes(spark, sf), levels=None, rounds=None)


@query()
def betweenness_sampled(spark, sf):
    return G.betweenness(P.pairs(spark, sf), P.nodes(spark, sf), 32, tables=True)


@query()
def power_law(spark, sf):
    """Exponent, start and fit of a discrete power law for in-, out- and total degrees, against a log-normal. The driver gets a row for each distinct degree."""
    d = E.degrees(P.pairs(spark, sf), P.nodes(spark, sf))
    rows = []
    for name in ("in_degree", "out_degree", "degree"):
        fit = G.power_law_fit([(r[0], r[1]) for r in d.groupBy(name).count().collect()])
        rows.append((name, fit["alpha"], fit["xmin"], fit["ks"], fit["tail"], fit["ratio"], fit["p"], bool(fit["ratio"] > 0 and fit["p"] < 0.05)))
    return spark.createDataFrame(rows, "direction string, alpha double, xmin long, ks double, tail long, ratio double, p double, strong boolean")


@query()
def null_models(spark, sf):
    """Pairs and clustering of the graph, a configuration model and an Erdos-Renyi graph of its size."""
    e, n = P.pairs(spark, sf), P.nodes(spark, sf)
    nodes, pairs = n.count(), E.undirected(e).count()
    graphs = {"given": E.undirected(e), "configuration": G.configuration_pairs(e, 42), "random": G.random_pairs(nodes, 2 * pairs / max(1, nodes * (nodes - 1)), 42, spark)}
    rows = [(name, *G.mean_clustering(g.selectExpr("a src", "b dst"), nodes)) for name, g in graphs.items()]  # one after another, a row each
    return spark.createDataFrame(rows, "model string, pairs long, clustering double").withColumn("clustering", fixed(F.col("clustering")))


def _curve_sql(keep: str, frame: str, sources: int) -> str:
    """Views that end in curve(key, giant, mean_path) from kept (key, a, b), the pairs that stand at each key; frame: all keys."""
    return f""", kept AS MATERIALIZED ({keep}
), arcs AS MATERIALIZED (SELECT key, a AS src, b AS dst FROM kept UNION ALL SELECT key, b, a FROM kept)""" + components_sql("parts", "arcs") + f"""
, sizes AS (SELECT key, component, count(*) AS n FROM parts GROUP BY 1, 2
), giant AS MATERIALIZED (SELECT key, component, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, component DESC) AS p FROM sizes) WHERE p = 1
), starts AS MATERIALIZED (SELECT key, id FROM (SELECT p.key, p.id, row_number() OVER (PARTITION BY p.key ORDER BY md5(p.id::VARCHAR || ':42'), p.id) AS n FROM parts p JOIN giant USING (key, component)) WHERE n <= {sources}
)""" + bfs_sql("far", "arcs", "starts") + f", curve AS (SELECT f.key, g.n AS giant, {r6('coalesce(m.m, 0)')} AS mean_path FROM {frame} f LEFT JOIN giant g USING (key) LEFT JOIN (SELECT key, avg(d) AS m FROM far WHERE d > 0 GROUP BY 1) m USING (key))"


#: Sources of a step's mean path.
_CURVE_SOURCES = 8
_ATTACK = _UND + """, deg2 AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM und UNION ALL SELECT b FROM und) GROUP BY 1
), n AS (SELECT count(*) AS n FROM nodes
), orders AS MATERIALIZED (SELECT 0 AS s, id, row_number() OVER (ORDER BY md5(id::VARCHAR || ':42'), id) AS number FROM nodes
    UNION ALL SELECT 1, id, row_number() OVER (ORDER BY coalesce(d, 0) DESC, id) FROM nodes LEFT JOIN deg2 USING (id)
), frame AS MATERIALIZED (SELECT s * 100 + step AS key, s, step, floor(fraction * n)::BIGINT AS removed FROM (VALUES (0), (1)) v(s), (VALUES """ + ", ".join(f"({k}, {float(f)!r}::DOUBLE)" for k, f in enumerate(np.linspace(0, 0.95, 20))) + """) r(step, fraction), n
)""" + _curve_sql("SELECT f.key, u.a, u.b FROM und u, frame f JOIN orders x ON x.s = f.s AND x.number > f.removed JOIN orders y ON y.s = f.s AND y.number > f.removed WHERE x.id = u.a AND y.id = u.b", "frame", _CURVE_SOURCES)


@query(_ATTACK + f"SELECT CASE s WHEN 0 THEN 'random' ELSE 'degree' END AS strategy, step::INTEGER AS step, removed, {r6('coalesce(giant, CASE WHEN removed < (SELECT n FROM n) THEN 1 ELSE 0 END)::DOUBLE / (SELECT n FROM n)')} AS giant_share, mean_path FROM frame JOIN curve USING (key)")
def attack_curve(spark, sf):
    """The giant component's share and mean path (from 8 sampled nodes) as nodes go at random and by degree, twenty fractions each."""
    e, n = P.pairs(spark, sf), P.nodes(spark, sf)
    out = C.attack_curve(e, n, C.attack_orders(e, n, names=("random", "degree")), sources=_CURVE_SOURCES)
    return out.select("strategy", "step", "removed", *[fixed(F.col(c)).alias(c) for c in ("giant_share", "mean_path")])


@query()
def attack_curve_betweenness(spark, sf):
    """The same as nodes go by betweenness, from all sources."""
    e, n = P.pairs(spark, sf), P.nodes(spark, sf)
    return C.attack_curve(e, n, C.attack_orders(e, n, names=("betweenness",)), sources=_CURVE_SOURCES)


@query(_DEGREES + f""", each AS (SELECT 'in' AS direction, i AS k FROM deg UNION ALL SELECT 'out', o FROM deg)
    SELECT direction, {r6('avg(k)')} AS mean, list_sort(list(k))[(count(*) // 2 + 1)::INTEGER] AS upper_median, max(k) AS largest, {r6('100.0::DOUBLE * count(*) FILTER (WHERE k > 0) / count(*)')} AS percent_above_zero FROM each GROUP BY 1""")
def direction_profile(spark, sf):
    """Mean, upper median and largest of in- and out-degrees."""
    d = E.degrees(P.edges(spark, sf), P.nodes(spark, sf))
    each = d.select(F.explode(F.array(*[F.struct(F.lit(name).alias("direction"), F.col(c).alias("k")) for name, c in (("in", "in_degree"), ("out", "out_degree"))])).alias("e")).select("e.*")
    return each.groupBy("direction").agg(fixed(F.avg("k")).alias("mean"), stats.upper_median("k").alias("upper_median"), F.max("k").alias("largest"), fixed(F.count_if(F.col("k") > 0) * 100.0 / F.count("*")).alias("percent_above_zero"))


@query(_UND + f""", deg2 AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM und UNION ALL SELECT b FROM und) GROUP BY 1),
    ks AS (SELECT DISTINCT d AS k FROM deg2), held AS (SELECT k, count(*) AS n FROM ks JOIN deg2 ON d > k GROUP BY 1),
    low AS (SELECT least(x.d, y.d) AS d FROM und JOIN deg2 x ON x.id = a JOIN deg2 y ON y.id = b), kept AS (SELECT k, count(*) AS m FROM ks JOIN low ON d > k GROUP BY 1)
    SELECT k AS degree, n AS nodes, coalesce(m, 0) AS pairs, {r6('2.0::DOUBLE * coalesce(m, 0) / (n * (n - 1))')} AS rich_club FROM held LEFT JOIN kept USING (k) WHERE n > 1""")
def rich_club(spark, sf):
    return C.rich_club(P.edges(spark, sf))


@query(_UND + """, f AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)
    SELECT n AS n_nodes, m AS n_edges, (SELECT count(*) FROM und) AS n_pairs, """ + r9("m / (n * (n - 1))::DOUBLE") + """ AS density FROM f""")
def edge_scalars(spark, sf):
    """Nodes, edges, pairs and directed density."""
    e, n = P.edges(spark, sf), P.nodes(spark, sf)
    one = e.agg(F.count("*").alias("n_edges")).crossJoin(E.undirected(e).agg(F.count("*").alias("n_pairs"))).crossJoin(n.agg(F.count("*").alias("n_nodes")))  # one row each
    return one.select("n_nodes", "n_edges", "n_pairs", fixed(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9).alias("density"))


_TOPOLOGY = _ARCS + components_sql("parts", "both_ways") + _UND + """, inside AS MATERIALIZED (SELECT id FROM parts WHERE component = (SELECT component FROM parts GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
), starts AS MATERIALIZED (SELECT 0 AS key, id FROM inside ORDER BY md5(id::VARCHAR || ':43'), id LIMIT 20)""" + bfs_sql("far", "both_ways", "starts") + """
, chosen AS MATERIALIZED (SELECT id FROM inside ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 1000
), und_in AS MATERIALIZED (SELECT * FROM und WHERE a IN (SELECT id FROM inside)
), deg_in AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM und_in UNION ALL SELECT b FROM und_in) GROUP BY 1
), tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM und_in x JOIN und_in y ON y.a = x.b JOIN und_in z ON z.a = x.a AND z.b = y.b
), t AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY 1
), first_start AS MATERIALIZED (SELECT 0 AS key, id FROM (SELECT id, sum(k) AS d FROM (SELECT src AS id, 1 AS k FROM edges UNION ALL SELECT dst, 1 FROM edges) WHERE id IN (SELECT id FROM inside) GROUP BY 1) ORDER BY d DESC, id LIMIT 1)""" + bfs_sql("one", "both_ways", "first_start") + """
, second_start AS MATERIALIZED (SELECT 0 AS key, id FROM one ORDER BY d DESC, id LIMIT 1)""" + bfs_sql("two", "both_ways", "second_start")


@query(_TOPOLOGY + f"""SELECT (SELECT {r6('avg(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END)')} FROM chosen JOIN deg_in USING (id) LEFT JOIN t USING (id)) AS mean_clustering, (SELECT {r6('avg(d)')} FROM far) AS mean_path,
    (SELECT max(d)::INTEGER FROM two) AS diameter, {r9('(SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1))::DOUBLE')} AS density""")
def topology_baseline(spark, sf):
    """Density, clustering and paths from sampled nodes of the giant component."""
    return C.topology_baseline(P.pairs(spark, sf), P.nodes(spark, sf))


# ---- the small-graph profile, stability, student

_PROTO = ["density", "inflation", "reciprocity", "superficiality", "assortativity", "rank_anomaly"]
_SAMPLE_Z = lambda f: f"CASE WHEN coalesce(stddev_samp({f}) OVER (), 0) > 1e-15 THEN ({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () ELSE 0 END"


@query(_PRE + _pagerank_sql("pp") + f""", shallow AS (SELECT src_community AS community, avg(CASE WHEN intent IN ('Background', 'Perfunctory') THEN 1 ELSE 0 END) AS superficiality FROM flagged WHERE internal GROUP BY 1
), own_out AS (SELECT src AS id, count(*) AS x FROM flagged WHERE internal GROUP BY 1), own_in AS (SELECT dst AS id, count(*) AS y FROM flagged WHERE internal GROUP BY 1
), mixing AS (SELECT src_community AS community, CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-15 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS assortativity
    FROM flagged JOIN own_out a ON a.id = src JOIN own_in b ON b.id = dst WHERE internal GROUP BY 1
), odd AS (SELECT n.community, avg(r - coalesce(d, 0) / (SELECT count(*) FROM edges)::DOUBLE) AS rank_anomaly FROM nodes n JOIN pp USING (id) LEFT JOIN indeg USING (id) GROUP BY 1
), f AS (SELECT community, size, {r9('density')} AS density, {r9('internal_edges / greatest(expected, 1.0::DOUBLE)')} AS inflation, {r9('reciprocity')} AS reciprocity,
    {r9('coalesce(superficiality, 0)')} AS superficiality, {r9('coalesce(assortativity, 0)')} AS assortativity, {r9('coalesce(rank_anomaly, 0)')} AS rank_anomaly
    FROM pre LEFT JOIN shallow USING (community) LEFT JOIN mixing USING (community) LEFT JOIN odd USING (community) WHERE size >= 3
), i AS (SELECT *, {r6('(' + ' + '.join(_SAMPLE_Z(f) for f in _PROTO) + ') / 6')} AS cartel_index FROM f) SELECT *, cartel_index > 2 AS flagged FROM i""")
def prototype_index(spark, sf):
    e, n = weighted(spark, sf), P.nodes(spark, sf)
    return O.prototype_index(e, n, G.pagerank(e, n))


@query(_PRE + f"SELECT community, size, internal_edges, {r9('density * size')} AS suspicion FROM pre WHERE size > 5 ORDER BY suspicion DESC, community LIMIT 3")
def dense_groups(spark, sf):
    return O.dense_groups(P.edges(spark, sf), P.nodes(spark, sf))


def _sweep_sql(name: str, start: str) -> str:
    levels = [f"{name}0 AS (SELECT id, 0 AS d FROM ({start}))"]
    levels += [f"{name}{k} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT * FROM {name}{k - 1} UNION ALL SELECT a.dst, {k} FROM {name}{k - 1} l JOIN arcs a ON a.src = l.id) GROUP BY 1)" for k in range(1, 9)]
    return ", " + ", ".join(levels)


_FAR = "SELECT id FROM {0}8 ORDER BY d DESC, id LIMIT 1"


@query(_DEGREES + ", arcs AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)" + _sweep_sql("u", "SELECT id FROM deg ORDER BY o + i DESC, id LIMIT 1") + _sweep_sql("v", _FAR.format("u"))
       + f"SELECT (SELECT id FROM u0) AS start, (SELECT id FROM v0) AS far, ({_FAR.format('v')}) AS other, (SELECT max(d)::INTEGER FROM v8) AS diameter")
def double_sweep(spark, sf):
    return O.double_sweep(P.pairs(spark, sf), P.nodes(spark, sf))


_REMOVAL = _PRE + f""", worst AS (SELECT community FROM (SELECT community, {r9('density * size')} AS suspicion FROM pre WHERE size > 5) ORDER BY suspicion DESC, community LIMIT 3
), targets AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY md5(edge_id || ':42'), edge_id) AS number FROM flagged WHERE internal AND src_community IN (SELECT community FROM worst)
), goes AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(number) AS at FROM targets WHERE src <> dst GROUP BY 1, 2
), frame AS MATERIALIZED (SELECT step AS key, floor(fraction * (SELECT count(*) FROM targets))::BIGINT AS removed FROM (VALUES {', '.join(f'({k}, {float(f)!r}::DOUBLE)' for k, f in enumerate(np.linspace(0, 1, 20)))}) r(step, fraction)
)""" + _curve_sql("SELECT f.key, u.a, u.b FROM (SELECT und.*, goes.at FROM und LEFT JOIN goes USING (a, b)) u, frame f WHERE u.at IS NULL OR u.at > f.removed", "frame", _CURVE_SOURCES)


@query(_REMOVAL + f"SELECT key::INTEGER AS step, removed, {r6('coalesce(giant, 1)::DOUBLE / (SELECT count(*) FROM nodes)')} AS giant_share, mean_path FROM frame JOIN curve USING (key)")
def edge_removal_curve(spark, sf):
    """The giant component's share and mean path (from 8 sampled nodes) as the internal edges of the three densest groups go, in 20 steps."""
    e, n = P.edges(spark, sf), P.nodes(spark, sf)
    worst = O.dense_groups(e, n).select(F.col("community").alias("src_community"))
    targets = E.with_communities(e, n).filter("internal").join(F.broadcast(worst), "src_community", "left_semi")  # three rows
    return O.removal_curve(e, n, targets, sources=_CURVE_SOURCES).select("step", "removed", *[fixed(F.col(c)).alias(c) for c in ("giant_share", "mean_path")])


@query()
def seed_stability(spark, sf):
    e, n = weighted(spark, sf), P.nodes(spark, sf)
    return B.seed_stability(e, n, levels=None, rounds=None)


@query()
def modularity_significance(spark, sf):
    return B.modularity_significance(P.pairs(spark, sf), P.nodes(spark, sf), nulls=10, levels=None, rounds=None)


@query()
def preferential_model(spark, sf):
    """(degree, n) of a graph grown by preference, of as many nodes as given."""
    pairs = B.preferential_pairs(spark, P.nodes(spark, sf).count(), 3, 42)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return degree.groupBy("degree").agg(F.count("*").alias("n"))


@query()
def student_inference(spark, sf):
    """Labels for the edges that have none, from a classifier of pair texts fitted on those that have."""
    e, n = P.edges(spark, sf), P.nodes(spark, sf)
    a, b = n.selectExpr("id src", "title src_title"), n.selectExpr("id dst", "title dst_title")
    pair = lambda rows: rows.join(a, "src", "left").join(b, "dst", "left").withColumn("text", F.concat_ws(" ", "src_title", "dst_title"))
    labelled = P.semantics(e)
    model = T.fit_student(pair(labelled).select("text", F.col("intent").alias("label")))
    rest = pair(e.join(labelled.select("edge_id"), "edge_id", "left_anti"))
    return T.infer(model, rest).select("edge_id", "student_label", "student_confidence")
