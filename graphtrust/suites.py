"""Registered queries of the labelling path: selections, replies, ingest, models. They join those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtrust.catalog import _ADAPTIVE, _DEGREES, _PARSED, _POOLS, _PRE, _REPLIES, _TOK, _UND, pools, query, r6
from graphtrust.functions import labels as L
from graphtrust.functions import text
from graphtrust.functions.stats import fixed
from graphtrust.operators import edges as E
from graphtrust.operators import graph as G
from graphtrust.operators import ranking as R
from graphtrust.operators import scores as S
from graphtrust.operators import selection as X
from graphtrust.plans import project as P
from graphtrust.runtime import checkpoint, spread_by, table

#: Edges that a selection aims at; seed of the selections; times the wanted edges of which similarity is looked at.
TARGET, SEED, MULTIPLIER = 1000, 42, 4


def papers(spark, sf: str) -> DataFrame:
    """(id, title, abstract) of the nodes; their domain stands in for an abstract."""
    return P.nodes(spark, sf).select("id", "title", F.col("domain").alias("abstract"))


def _draw_sql(rows: str, n: str | int, seed: int) -> str:
    return f"SELECT edge_id FROM ({rows}) ORDER BY md5(edge_id || ':{seed}'), edge_id LIMIT {n}"


def _low_sql(candidates: str, n: int, seed: int, most: int) -> str:
    """The n candidates (edge_id) of least similarity."""
    words = _TOK("substring(concat(coalesce(title, ''), ' ', coalesce(domain, '')), 1, 1200)")
    jaccard = "CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END"
    return f"""SELECT edge_id, {jaccard} AS lexical_jaccard FROM ({_draw_sql(candidates, most, seed)}) JOIN edges USING (edge_id) JOIN (SELECT id, {words} AS t FROM nodes) a ON a.id = src JOIN (SELECT id, {words} AS t FROM nodes) b ON b.id = dst
        ORDER BY lexical_jaccard, edge_id LIMIT {n}"""


_OF = lambda *names: f"SELECT DISTINCT edge_id FROM pools WHERE pool IN ({', '.join(repr(n) for n in names)})"


def _quota_sql(shares: tuple, filler: str, filler_seed: int) -> str:
    parts, union = "", []
    for k, (name, share) in enumerate(shares):
        n = int(TARGET * share)
        rows = f"SELECT edge_id FROM ({_low_sql(_OF('random', 'touching'), n, SEED, min(100_000, 20 * n))})" if name == "low_similarity" else _draw_sql(_OF(name), n, SEED)
        parts += f", q{k} AS MATERIALIZED ({rows})"
        union.append(f"SELECT edge_id, '{name}' AS pool, {k} AS k FROM q{k}")
    parts += f", picked AS MATERIALIZED (SELECT edge_id, arg_min(pool, k) AS pool FROM ({' UNION ALL '.join(union)}) GROUP BY 1)"
    rest = _draw_sql("SELECT DISTINCT edge_id FROM pools WHERE edge_id NOT IN (SELECT edge_id FROM picked)", f"(SELECT {TARGET} - count(*) FROM picked)", filler_seed)
    return _POOLS + parts + f" SELECT edge_id, pool FROM picked UNION ALL SELECT edge_id, '{filler}' FROM ({rest})"


def _by_quota(spark, sf: str, shares: tuple, filler: str, filler_seed: int, strict: bool = False) -> DataFrame:
    held = pools(spark, sf)
    share = dict(shares).get("low_similarity")
    low = None
    if share:
        n = int(TARGET * share)
        low = X.low_similarity(held.filter(F.col("pool").isin("random", "touching")), papers(spark, sf), n, SEED, min(100_000, 20 * n))
    return X.by_quota(held, shares, TARGET, SEED, filler, filler_seed, low, strict)


@query(_quota_sql(X.PILOT, "pilot_filler", SEED))
def pilot_selection(spark, sf):
    """Five pools by quota and a filler of the same seed."""
    return _by_quota(spark, sf, X.PILOT, "pilot_filler", SEED)


@query(_quota_sql(X.CALIBRATION, "calibration_filler", SEED + 1))
def calibration_selection(spark, sf):
    return _by_quota(spark, sf, X.CALIBRATION, "calibration_filler", SEED + 1)


@query(_quota_sql(X.FINAL, "final_filler", SEED + 1))
def final_selection(spark, sf):
    """Six pools by quota and a filler; raises where there are fewer edges than wanted."""
    return _by_quota(spark, sf, X.FINAL, "final_filler", SEED + 1, strict=True)


@query(_POOLS + f", low AS ({_low_sql(_OF('random', 'touching'), 150, SEED, 3000)}) SELECT edge_id, {r6('lexical_jaccard')} AS lexical_jaccard FROM low")
def low_similarity_edges(spark, sf):
    rows = X.low_similarity(pools(spark, sf).filter("pool in ('random', 'touching')"), papers(spark, sf), 150, SEED, 3000)
    return rows.select("edge_id", fixed(F.col("lexical_jaccard")).alias("lexical_jaccard"))


#: Edges that count as labelled already: by a student, or by a teacher.
_USED_SQL = ", used AS MATERIALIZED (SELECT edge_id FROM semantics WHERE confidence < 0.2 OR confidence > 0.9)"


def used_edges(spark, sf: str) -> DataFrame:
    return P.semantics(P.edges(spark, sf)).filter("confidence < 0.2 or confidence > 0.9").select("edge_id")


def _exclusive_sql(steps: list[tuple[str, str, int, int, int | None]], extra: str = "") -> str:
    """steps: (name, rows, n, seed, most); most: by similarity among so many."""
    parts, taken = extra + _USED_SQL, ["used"]
    for k, (name, rows, n, seed, most) in enumerate(steps):
        gone = " AND ".join(f"edge_id NOT IN (SELECT edge_id FROM {t})" for t in taken)
        left = f"SELECT DISTINCT edge_id FROM ({rows}) WHERE {gone}"
        chosen = _draw_sql(left, n, seed) if most is None else f"SELECT edge_id FROM ({_low_sql(left, n, seed, most)})"
        parts += f", g{k} AS MATERIALIZED ({chosen})"
        taken.append(f"g{k}")
    return parts + " " + " UNION ALL ".join(f"SELECT edge_id, '{name}' AS selection_group FROM g{k}" for k, (name, *_) in enumerate(steps))


def _left(steps: list[tuple[str, int]]) -> str:
    return f"(SELECT greatest(0, {TARGET} - {' - '.join(f'(SELECT count(*) FROM g{k})' for k in range(len(steps)))}))"


_N = {name: int(TARGET * share) for name, share in X.TARGETED.items()}
_TARGET_STEPS = [(name, _OF(name), _N[name], SEED, None) for name in ("reciprocal", "inflated", "dense", "touching")] + [
    ("low_similarity", _OF("touching", "inflated"), _N["low_similarity"], SEED + 17, MULTIPLIER * _N["low_similarity"]),
    ("random_control", "SELECT edge_id FROM edges", _N["random_control"], SEED + 101, None),
]


@query(_POOLS + _exclusive_sql([*_TARGET_STEPS, ("filler_control", "SELECT edge_id FROM edges", _left(_TARGET_STEPS), SEED + 202, None)]))
def targeted_selection(spark, sf):
    """Six groups that exclude one another and what is labelled, the fifth by similarity, and a filler."""
    held, every, texts = pools(spark, sf), P.edges(spark, sf), papers(spark, sf)
    used = checkpoint(used_edges(spark, sf))
    n_used, of = used.count(), lambda *names: held.filter(F.col("pool").isin(*names))
    steps = [(name, lambda u, name=name: X.unused(of(name), u, _N[name], SEED)) for name in ("reciprocal", "inflated", "dense", "touching")]
    n = _N["low_similarity"]
    steps += [
        ("low_similarity", lambda u: X.low_similarity(of("touching", "inflated").join(u, "edge_id", "left_anti"), texts, n, SEED + 17, MULTIPLIER * n)),
        ("random_control", lambda u: X.unused(every, u, _N["random_control"], SEED + 101)),
        ("filler_control", lambda u: X.unused(every, u, max(0, TARGET + n_used - u.count()), SEED + 202)),
    ]
    return X.exclusively(steps, used)


_A = {name: int(TARGET * share) for name, share in X.ADAPTIVE.items()}
_TOPS = f"""{_ADAPTIVE}, tops AS MATERIALIZED (SELECT community FROM adaptive ORDER BY adaptive_score DESC, community LIMIT 5
), inflated AS MATERIALIZED (SELECT community FROM (SELECT community, internal_edges / greatest(expected, 1e-9) AS x FROM pre) ORDER BY floor(x * 1e9 + 0.5) DESC, community LIMIT 5)"""
_IN_TOPS = "src_community IN (SELECT community FROM tops)"
_ADAPTIVE_STEPS = [
    ("top_internal", f"SELECT edge_id FROM flagged WHERE internal AND {_IN_TOPS}", _A["top_internal"], SEED, None),
    ("top_boundary", f"SELECT edge_id FROM flagged WHERE NOT internal AND ({_IN_TOPS} OR dst_community IN (SELECT community FROM tops))", _A["top_boundary"], SEED + 1, None),
    ("inflated_internal", "SELECT edge_id FROM flagged WHERE internal AND src_community IN (SELECT community FROM inflated)", _A["inflated_internal"], SEED + 2, None),
    ("low_similarity", f"SELECT edge_id FROM flagged WHERE {_IN_TOPS} OR dst_community IN (SELECT community FROM tops)", _A["low_similarity"], SEED + 3, MULTIPLIER * _A["low_similarity"]),
    ("random_control", "SELECT edge_id FROM edges", _A["random_control"], SEED + 4, None),
]


@query(_exclusive_sql([*_ADAPTIVE_STEPS, ("filler_control", "SELECT edge_id FROM edges", _left(_ADAPTIVE_STEPS), SEED + 5, None)], _PRE + _TOPS))
def adaptive_selection(spark, sf):
    """Five groups around the communities that adaptive ranking puts first, excluding one another and what is labelled, and a filler."""
    e, nodes, texts = P.edges(spark, sf), P.nodes(spark, sf), papers(spark, sf)
    flagged = S.flagged_edges(e, nodes)
    pre = checkpoint(S.precommunity_scores(flagged, nodes))
    tops = F.broadcast(S.adaptive_ranking(pre, P.semantics(e), nodes).limit(5).select("community", F.lit(True).alias("top")))  # five rows
    inflated = F.broadcast(pre.orderBy(F.desc(F.floor(F.col("inflation") * 1e9 + 0.5)), "community").limit(5).select("community", F.lit(True).alias("inflated")))  # five rows
    named = flagged.join(tops.selectExpr("community src_community", "top a"), "src_community", "left").join(tops.selectExpr("community dst_community", "top b"), "dst_community", "left")
    named = checkpoint(named.join(inflated.withColumnRenamed("community", "src_community"), "src_community", "left").select("edge_id", "src", "dst", "internal", "a", "b", "inflated"))
    used = checkpoint(used_edges(spark, sf))
    n_used, n = used.count(), _A["low_similarity"]
    some = lambda where, name, k: (name, lambda u: X.unused(named.filter(where), u, _A[name], SEED + k))
    steps = [
        some("internal and a", "top_internal", 0), some("not internal and (a or b)", "top_boundary", 1), some("internal and inflated", "inflated_internal", 2),
        ("low_similarity", lambda u: X.low_similarity(named.filter("a or b").join(u, "edge_id", "left_anti"), texts, n, SEED + 3, MULTIPLIER * n)),
        some("true", "random_control", 4), ("filler_control", lambda u: X.unused(named, u, max(0, TARGET + n_used - u.count()), SEED + 5)),
    ]
    return X.exclusively(steps, used)


@query(f"SELECT edge_id, row_number() OVER (ORDER BY md5(edge_id || ':42'), edge_id) AS turn, (row_number() OVER (ORDER BY md5(edge_id || ':42'), edge_id) - 1) % 5 AS model FROM ({_draw_sql('SELECT edge_id FROM edges', 3000, 42)})")
def round_robin_edges(spark, sf):
    """3,000 random edges, dealt to five models in turn."""
    return X.in_turn(P.edges(spark, sf), "edge_id", 3000, 42, 5).select("edge_id", F.col("turn").cast("long").alias("turn"), F.col("model").cast("long").alias("model"))


# ---- replies


_SELECTED = "selected AS MATERIALIZED (SELECT edge_id, src, dst, row_number() OVER (ORDER BY md5(edge_id || ':8'), edge_id) AS line FROM edges ORDER BY line LIMIT 800)"
_CASES = " ".join(f"WHEN {k} THEN {'NULL' if r is None else repr(r)}" for k, r in enumerate(_REPLIES))


@query(f", {_SELECTED}, replies AS (SELECT edge_id, line, CASE line % 13 {_CASES} END AS content FROM selected WHERE line % 7 <> 3), {_PARSED} SELECT s.edge_id, s.src, s.dst, l.label, l.confidence FROM selected s JOIN labelled l ON l.edge_id = s.edge_id WHERE l.error IS NULL")
def teacher_batch(spark, sf):
    """Responses of a batch service, parsed and joined with the edges that were asked about."""
    selected, responses = _responses(spark, sf)
    return L.joined_labels(responses, selected).select("edge_id", "src", "dst", "label", "confidence")


@query(f", {_SELECTED}, replies AS (SELECT edge_id, line, CASE line % 13 {_CASES} END AS content FROM selected WHERE line % 7 <> 3), {_PARSED} SELECT line AS line_no, edge_id, error FROM labelled WHERE error IS NOT NULL")
def teacher_batch_failures(spark, sf):
    """The responses that gave no label, and why."""
    return L.parse_responses(_responses(spark, sf)[1]).filter("error is not null").select("line_no", "edge_id", "error")


def _responses(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """(selected edges, (line_no, value) responses as a service sends them): for six of seven edges, good and bad."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.orderBy(R.draw("edge_id", 8), "edge_id"))
    selected = checkpoint(R.sample(P.edges(spark, sf), "edge_id", 800, 8).withColumn("line", n))  # 800 rows
    content = F.expr("CASE line % 13 " + _CASES + " END")
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    value = F.to_json(F.struct(F.col("edge_id").alias("custom_id"), F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response")))
    return selected, selected.filter("line % 7 <> 3").select(F.col("line").cast("long").alias("line_no"), value.alias("value"))


_OLD_NAMES = ("Background", "Method", "Result/Comparison", "Support", "Contrast/Criticism", "Perfunctory/Ceremonial")


@query(f"SELECT conv_id, turn, coalesce({', '.join(f"CASE WHEN contains(lower(text), '{n}') THEN '{n}' END" for n in ('and', 'er', 'on'))}, 'none') AS named FROM conversations", views=False)
def first_named_label(spark, sf):
    """The first of some names that a reply holds, with a fallback."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.first_named(F.col("text"), ("and", "er", "on"), "none").alias("named"))


@query("SELECT event_id, CASE WHEN try_cast(v AS DOUBLE) > 0 THEN try_cast(v AS DOUBLE) END AS positive FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '-3' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)", views=False)
def type_guard(spark, sf):
    """Only positive numbers pass."""
    v = F.expr("CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '-3' ELSE CAST(event_id AS STRING) END")
    return table(spark, sf, "events").select("event_id", text.positive_number(v).alias("positive"))


@query(f"SELECT edge_id, coalesce(a.title, '') AS citing_title, coalesce(a.domain, '') AS citing_abstract, coalesce(b.title, '') AS cited_title, coalesce(b.domain, '') AS cited_abstract FROM ({_draw_sql('SELECT edge_id FROM edges', 500, 3)}) JOIN edges USING (edge_id) LEFT JOIN nodes a ON a.id = src AND a.id % 5 <> 0 LEFT JOIN nodes b ON b.id = dst AND b.id % 5 <> 0")
def edge_texts(spark, sf):
    """Titles and abstracts of both ends of sampled edges, empty where unknown."""
    known = papers(spark, sf).filter("id % 5 <> 0")
    return X.with_texts(R.sample(P.edges(spark, sf), "edge_id", 500, 3), known).drop("src", "dst")


@query("SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_OLD_NAMES)) + " END AS label FROM events WHERE event_id % 8 < 6 OR event_id % 3 = 0", views=False)
def class_names(spark, sf):
    """Class numbers as names; numbers without one are null."""
    rows = table(spark, sf, "events").filter("event_id % 8 < 6 or event_id % 3 = 0")
    return rows.select("event_id", L.name_of(F.pmod("event_id", F.lit(8))).alias("label"))


# ---- ingest


@query("""
    SELECT count(*) AS n_nodes, sum(k)::BIGINT AS n_references, count(*) FILTER (WHERE k = 0) AS without_references, floor(avg(k) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS mean_out_degree
    FROM (SELECT o_orderkey, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""", views=False)
def raw_paper_stats(spark, sf):
    """Nodes, references, nodes without any, and mean out-degree of raw records (orders stand in for papers, their lines for references)."""
    from graphtrust.sources.readers import paper_stats

    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("references"))
    raw = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), "references")
    return paper_stats(raw)


_RECORDS = """records AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS n_citation, 1990 + p_partkey % 30 AS year FROM part WHERE p_partkey % 4 <> 1
), refs AS (SELECT src, dst FROM raw_edges)"""


@query(f""", {_RECORDS} SELECT sha1(concat(CAST(src AS VARCHAR), '->', CAST(dst AS VARCHAR))) AS edge_id, src::VARCHAR AS citing_id, dst::VARCHAR AS cited_id, count(*) AS n FROM refs
    WHERE src IN (SELECT id FROM records) AND dst IN (SELECT id FROM records) GROUP BY ALL""")
def canonical_edges(spark, sf):
    """Closed-world edges of the canonical tables, with how often each stands (references that repeat are kept)."""
    _, _, edges, _ = _canonical(spark, sf)
    return edges.groupBy("edge_id", "citing_id", "cited_id").agg(F.count("*").alias("n"))


@query(f""", {_RECORDS} SELECT r.id::VARCHAR AS paper_id, coalesce(title, '') AS title, year, coalesce(n_citation, 0)::BIGINT AS n_citation, 'Unknown' AS top_fos, '' AS abstract, coalesce(k, 0) AS out_reference_count_raw
    FROM records r LEFT JOIN (SELECT src AS id, count(*) AS k FROM refs GROUP BY 1) USING (id)""")
def canonical_papers(spark, sf):
    """Papers of the canonical tables: defaults for what is missing."""
    return _canonical(spark, sf)[0]


@query(f""", {_RECORDS}, kept AS (SELECT src, dst FROM refs WHERE src IN (SELECT id FROM records) AND dst IN (SELECT id FROM records))
    SELECT (SELECT count(*) FROM records) AS node_count, (SELECT count(*) FROM kept) AS edge_count, {r6('(SELECT count(*) FROM kept)::DOUBLE / (SELECT count(*) FROM records)')} AS edge_node_ratio""")
def canonical_manifest(spark, sf):
    return _canonical(spark, sf)[3]


def _canonical(spark, sf: str) -> tuple[DataFrame, ...]:
    from graphtrust.plans.canonical import canonical_tables

    refs = spread_by(P.raw_edges(spark, sf), "src").groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("references"))
    part = table(spark, sf, "part").filter("p_partkey % 4 <> 1")
    records = part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("title"), (1990 + F.col("p_partkey") % 30).alias("year"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).cast("long").alias("n_citation"),
    ).join(refs, "id", "left")
    none = "cast(null as array<struct<name: string, w: double>>)"
    index = "cast(null as struct<IndexLength: int, InvertedIndex: map<string, array<int>>>)"
    return canonical_tables(records.withColumns({"fos": F.expr(none), "indexed_abstract": F.expr(index)}))


@query("SELECT id, title, domain FROM nodes WHERE id IN (SELECT src FROM edges WHERE (src + dst) % 50 = 0)")
def metadata_of_nodes(spark, sf):
    """Metadata of a set of nodes only."""
    wanted = P.pairs(spark, sf).filter("(src + dst) % 50 = 0").select(F.col("src").alias("id")).distinct()
    return P.nodes(spark, sf).join(wanted, "id", "left_semi").select("id", "title", "domain")


@query(_DEGREES + "SELECT id, i AS in_degree FROM deg ORDER BY i DESC, id LIMIT 200")
def most_cited(spark, sf):
    """The seeds of a snowball sample."""
    return E.degrees(P.pairs(spark, sf), P.nodes(spark, sf)).orderBy(F.desc("in_degree"), "id").limit(200).select("id", "in_degree")


# ---- graph tables


@query(_DEGREES + """SELECT id, n_out, n_in, least_out, least_in FROM (SELECT id FROM deg WHERE d > 0) JOIN
    (SELECT id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, least_out, least_in FROM (SELECT src AS id, count(*) AS n_out, min(dst) AS least_out FROM edges GROUP BY 1) FULL JOIN (SELECT dst AS id, count(*) AS n_in, min(src) AS least_in FROM edges GROUP BY 1) USING (id)) USING (id)""")
def adjacency_index(spark, sf):
    """Sizes and least members of every node's neighbour lists."""
    a = G.adjacency(P.pairs(spark, sf))
    return a.select("id", F.size("out").cast("long").alias("n_out"), F.size("into").cast("long").alias("n_in"), F.array_min("out").alias("least_out"), F.array_min("into").alias("least_in"))


_BIN = "floor(log2({0}) * 2.0::DOUBLE + 1e-9)::BIGINT"


@query(_DEGREES + f"SELECT {_BIN.format('d')} AS bin, count(*) AS n, min(d) AS least, max(d) AS largest FROM deg WHERE d > 0 GROUP BY 1")
def degree_log_bins(spark, sf):
    """Nodes by degree in bins that grow by the square root of two."""
    d = E.degrees(P.pairs(spark, sf), P.nodes(spark, sf)).filter("degree > 0")
    return d.groupBy(F.floor(F.log2("degree") * 2.0 + 1e-9).alias("bin")).agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("largest"))


@query(_DEGREES + f"SELECT d AS degree, n, {r6('(SELECT count(*) FROM deg x WHERE x.d >= k.d)::DOUBLE / (SELECT count(*) FROM deg)')} AS ccdf FROM (SELECT d, count(*) AS n FROM deg GROUP BY 1) k")
def degree_ccdf(spark, sf):
    """The share of nodes of each degree or more; summed over distinct degrees."""
    from pyspark.sql.window import Window

    counts = E.degrees(P.pairs(spark, sf), P.nodes(spark, sf)).groupBy("degree").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("degree")))  # a row for each degree
    return counts.select("degree", "n", fixed(above / F.sum("n").over(Window.partitionBy())).alias("ccdf"))


@query(_DEGREES + f""", xy AS (SELECT ln(1 + o) / 0.25::DOUBLE AS x, ln(1 + i) / (0.25::DOUBLE * sqrt(3.0::DOUBLE)) AS y FROM deg
), cells AS (SELECT x, y, floor(x + 0.5::DOUBLE) AS x1, floor(y + 0.5::DOUBLE) AS y1, floor(x) AS x2, floor(y) AS y2 FROM xy
), near AS (SELECT *, (x - x1) * (x - x1) + 3.0::DOUBLE * (y - y1) * (y - y1) <= (x - x2 - 0.5::DOUBLE) * (x - x2 - 0.5::DOUBLE) + 3.0::DOUBLE * (y - y2 - 0.5::DOUBLE) * (y - y2 - 0.5::DOUBLE) AS first FROM cells)
    SELECT {r6('CASE WHEN first THEN x1 ELSE x2 + 0.5::DOUBLE END')} AS cell_x, {r6('CASE WHEN first THEN y1 ELSE y2 + 0.5::DOUBLE END')} AS cell_y, count(*) AS n FROM near GROUP BY 1, 2""")
def degree_hexbin(spark, sf):
    """Nodes by hexagonal cells of the logarithms of out- and in-degree: of two shifted grids, the nearer centre."""
    d = E.degrees(P.pairs(spark, sf), P.nodes(spark, sf))
    return hexbin(d, F.log(1 + F.col("out_degree")), F.log(1 + F.col("in_degree")), 0.25)


def hexbin(rows: DataFrame, x, y, width: float) -> DataFrame:
    """(cell_x, cell_y, n): rows by hexagons of this width; cells are named by their centres, in units of a hexagon."""
    xy = rows.select((x / width).alias("x"), (y / (width * 3**0.5)).alias("y"))
    one = (F.floor(F.col("x") + 0.5).cast("double"), F.floor(F.col("y") + 0.5).cast("double"))
    two = (F.floor("x").cast("double") + 0.5, F.floor("y").cast("double") + 0.5)
    far = lambda c: (F.col("x") - c[0]) * (F.col("x") - c[0]) + 3.0 * (F.col("y") - c[1]) * (F.col("y") - c[1])
    first = far(one) <= far(two)
    return xy.select(*[fixed(F.when(first, a).otherwise(b)).alias(c) for c, a, b in (("cell_x", one[0], two[0]), ("cell_y", one[1], two[1]))]).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


@query(", f AS (SELECT count(*) FILTER (WHERE r.src IS NOT NULL) AS back, count(*) AS m FROM edges e LEFT JOIN edges r ON r.src = e.dst AND r.dst = e.src WHERE e.src <> e.dst) SELECT m AS n_edges, back AS reciprocal_edges, " + r6("back / m::DOUBLE") + " AS reciprocity FROM f")
def global_reciprocity(spark, sf):
    """The share of edges, loops left out, whose reverse exists."""
    e = E.with_reciprocal(P.pairs(spark, sf).filter("src <> dst"))
    back = F.count_if(F.col("reciprocal"))
    return e.agg(F.count("*").alias("n_edges"), back.alias("reciprocal_edges"), fixed(F.coalesce(F.try_divide(back, F.count("*")), F.lit(0.0))).alias("reciprocity"))


_SOME = ", und AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst AND src <= 150 AND dst <= 150), both_ways AS MATERIALIZED (SELECT 0 AS key, a AS src, b AS dst FROM und UNION ALL SELECT 0, b, a FROM und)"


def _exact_path_sql() -> str:
    from graphtrust.catalog import bfs_sql, components_sql

    return _SOME + components_sql("parts", "both_ways") + ", starts AS MATERIALIZED (SELECT key, id FROM parts WHERE component = (SELECT component FROM parts GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1))" + bfs_sql("far", "both_ways", "starts") + f" SELECT (SELECT count(*) FROM starts) AS giant, {r6('coalesce(avg(d) FILTER (WHERE d > 0), 0)')} AS mean_path FROM far"


@query(_exact_path_sql())
def exact_mean_path(spark, sf):
    """Of all pairs in the largest component of the first 150 nodes' graph."""
    e = P.pairs(spark, sf).filter("src <= 150 and dst <= 150")
    return G.mean_path(e, P.nodes(spark, sf).filter("id <= 150")).select("giant", fixed(F.col("mean_path")).alias("mean_path"))


#: The sixteen classes of triads, by which of a-b, b-c and a-c are linked and how.
@query(_UND + """, arcs AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), n AS (SELECT count(*)::HUGEINT AS n FROM nodes
), kinds AS (SELECT a, b, (SELECT count(*) FROM arcs WHERE src = a AND dst = b) + (SELECT count(*) FROM arcs WHERE src = b AND dst = a) AS k FROM und
), tri AS (SELECT x.a AS p, x.b AS q, y.b AS r, x.k + y.k + z.k AS arcs, (x.k = 2)::INT + (y.k = 2)::INT + (z.k = 2)::INT AS mutual FROM kinds x JOIN kinds y ON y.a = x.b JOIN kinds z ON z.a = x.a AND z.b = y.b)
    SELECT mutual::INTEGER AS mutual, (3 - mutual)::INTEGER AS single, count(*) AS n FROM tri GROUP BY 1, 2""")
def closed_triads(spark, sf):
    """Triangles by how many of their three links are mutual."""
    return G.closed_triads(P.pairs(spark, sf))


@query(_UND + "SELECT year, count(*) AS n_nodes, sum(count(*)) OVER (ORDER BY year)::BIGINT AS nodes_so_far, sum(coalesce(any_value(l), 0)) OVER (ORDER BY year)::BIGINT AS links_so_far FROM (SELECT id, 1990 + id % 30 AS year FROM nodes) LEFT JOIN (SELECT greatest(1990 + a % 30, 1990 + b % 30) AS year, count(*) AS l FROM und GROUP BY 1) USING (year) GROUP BY 1")
def growth(spark, sf):
    """Nodes and links by year, and so far: a link is there when both its ends are."""
    years = P.nodes(spark, sf).select("id", (1990 + F.col("id") % 30).alias("year"))
    return G.growth(P.pairs(spark, sf), years)
