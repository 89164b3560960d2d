"""The worked micro-graph, degenerate inputs, and a sample of the queries against their SQL."""

import numpy as np
import pytest

from graphtrust import catalog
from graphtrust.functions import labels as L
from graphtrust.functions import stats, text
from graphtrust.operators import edges as E
from graphtrust.operators import graph as G
from graphtrust.operators import ranking as R
from graphtrust.operators import scores as S
from graphtrust.operators.components import connected_components
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LINKS = [
    ("a", "b", "Method"), ("b", "a", "Background"), ("b", "c", "Background"), ("c", "a", "Perfunctory/Ceremonial"), ("d", "e", "Result/Comparison"),
    ("e", "f", None), ("f", "d", "Support"), ("c", "d", "Background"), ("a", "e", "Method"), ("g", "a", "Background"),
]
NODE = {c: k for k, c in enumerate("abcdefg", 1)}


@pytest.fixture(scope="module")
def micro(spark):
    nodes = spark.createDataFrame([(NODE[c], k) for k, group in enumerate(("abc", "def", "g")) for c in group], "id long, community int")
    rows = [(f"{s}{d}", NODE[s], NODE[d], i, dict(zip(L.INTENTS, L.WEIGHTS)).get(i), 0.5) for s, d, i in LINKS]
    e = spark.createDataFrame(rows, "edge_id string, src long, dst long, intent string, weight double, confidence double")
    return E.weighted_edges(e.select("edge_id", "src", "dst"), e.filter("intent is not null")), nodes


def test_pagerank_and_index_of_the_micro_graph(micro):
    edges, nodes = micro
    shifts = S.pagerank_shifts(edges, nodes)
    ranks = {r["id"]: r for r in shifts.collect()}
    plain = {"a": 0.083123, "b": 0.056756, "c": 0.045550, "d": 0.259170, "e": 0.277052, "f": 0.256921, "g": 0.021429}
    trust = {"a": 0.074723, "b": 0.053186, "c": 0.044032, "d": 0.266980, "e": 0.280121, "f": 0.259530, "g": 0.021429}
    for c, k in NODE.items():
        assert ranks[k]["rank_plain"] == pytest.approx(plain[c], abs=6e-7) and ranks[k]["rank_trust"] == pytest.approx(trust[c], abs=6e-7)
        assert ranks[k]["place_plain"] == ranks[k]["place_trust"] == "edfabcg".index(c) + 1 and ranks[k]["rank_drop"] == 0
    got = {r["community"]: r for r in S.community_scores(edges, nodes, shifts).collect()}
    assert [round(got[k]["mean_pagerank_drop"], 9) for k in range(3)] == [0.004495763, -0.004495763, 0]
    assert [got[k]["cci"] for k in range(3)] == pytest.approx([0.909407382, -0.214885407, -0.694521975], abs=1e-6)
    assert [got[k]["structural_cci"] for k in range(3)] == pytest.approx([0.808446147, -0.116441132, -0.692005014], abs=1e-6)
    assert (got[0]["internal_edges"], got[0]["reciprocal_edges"], got[0]["shallow_edges"]) == (4, 2, 3) and got[2]["internal_edges"] == 0
    assert got[0]["assortativity"] == 0 and got[0]["mean_unweighted_pagerank"] == pytest.approx((0.083123 + 0.056756 + 0.045550) / 3, abs=1e-6)
    extremes = S.shift_extremes(shifts, nodes.withColumn("title", F.lit("t")), ["title", "year"], 2).collect()
    assert [(r["kind"], r["id"], r["title"]) for r in sorted(extremes, key=lambda r: (r["kind"], r["id"]))] == [("drop", 1, "t"), ("drop", 2, "t"), ("gain", 1, "t"), ("gain", 2, "t")]


def test_ranks_stop_each_for_itself(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.0), (3, 1, 0.1), (3, 4, 1.0), (None, 1, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "id long")
    arcs = {(1, 2): 1.0, (2, 3): 0.0, (3, 1): 0.1, (3, 4): 1.0}
    both = {r["id"]: r for r in G.pageranks(e, nodes, {"plain": None, "trust": "weight"}, tol=1e-12, stop="l1").collect()}
    for name, weights in (("plain", {k: 1.0 for k in arcs}), ("trust", {k: w for k, w in arcs.items() if w})):
        want = plain_ranks([1, 2, 3, 4, 9], weights)
        assert all(both[i][name] == pytest.approx(want[i], abs=1e-9) for i in want)
    assert G.pagerank(e, nodes.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        G.pagerank(e, nodes, rounds=1, tol=1e-12, stop="l1")


def test_components_paths_and_bow_tie(spark, micro):
    edges, nodes = micro
    assert {r["component"] for r in connected_components(edges).collect()} == {1}
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0
    far = G.bfs(edges, nodes.filter("id = 7"), directed=True).collect()
    assert {r["id"]: r["distance"] for r in far} == {7: 0, 1: 1, 2: 2, 5: 2, 3: 3, 6: 3, 4: 4}
    assert {r["id"]: r["part"] for r in G.bow_tie(edges, nodes).collect()}[7] == "in"


def test_traps(spark):
    e = spark.createDataFrame([("x", 1, 1), ("y", 1, 2)], "edge_id string, src long, dst long")
    assert {r["edge_id"]: r["reciprocal"] for r in E.with_reciprocal(e).collect()} == {"x": True, "y": False}
    n = spark.createDataFrame([(1, None), (2, None)], "id long, community string")
    assert not any(r["internal"] for r in E.with_communities(e, n).collect())
    scores = spark.createDataFrame([(k, float(k // 2), 1.0) for k in range(4)], "community int, a double, b double")
    assert [r["p"] for r in scores.select("community", stats.percent_rank("a").alias("p")).orderBy("community").collect()] == [0.375, 0.375, 0.875, 0.875]
    assert S.spearman(scores, "a", "b").first()[0] == 0
    parts = R.chunks(spark.createDataFrame([(k, 10) for k in range(7)], "k long, b long"), "k", "b", 3, 25).orderBy("k").collect()
    assert [r["chunk"] for r in parts] == [0, 0, 1, 1, 2, 2, 3]


def test_replies_and_text(spark):
    replies = ['{"label":"method","confidence":0.9}', '{"label":"This is Support","confidence":"1.7"}', '{"label":"other"}', "not json", None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, c string").select("k", L.parse_reply(F.col("c")).alias("r")).select("k", "r.*").orderBy("k")
    got = [(r["label"], r["confidence"], r["error"]) for r in df.collect()]
    assert got == [("Method", 0.9, None), ("Support", 1.0, None), (None, None, "unknown_label: other"), (None, None, "json_decode_error"), (None, None, "missing_message_content")]
    words = spark.createDataFrame([([("b", 3), ("a", 0), ("z", 3)],)], "w array<struct<word:string,pos:int>>")
    assert words.select(text.text_from_index(F.col("w"))).first()[0] == "a   z"


def plain_ranks(nodes, arcs):
    """Stationary ranks by plain power iteration; arcs: {(src, dst): weight}."""
    total = {}
    for (a, _), w in arcs.items():
        total[a] = total.get(a, 0) + w
    rank = {i: 1 / len(nodes) for i in nodes}
    for _ in range(200):
        lost = sum(r for i, r in rank.items() if not total.get(i))
        new = {i: (0.15 + 0.85 * lost) / len(nodes) for i in nodes}
        for (a, b), w in arcs.items():
            new[b] += 0.85 * rank[a] * w / total[a]
        rank = new
    return rank


def test_index_takes_the_drop_of_stationary_ranks(spark):
    nodes = {r["id"]: r["community"] for r in catalog.P.nodes(spark, SF).collect()}
    edges = catalog.weighted(spark, SF).collect()
    plain = plain_ranks(nodes, {(r["src"], r["dst"]): 1.0 for r in edges})
    trust = plain_ranks(nodes, {(r["src"], r["dst"]): r["weight"] for r in edges})
    found = {r["id"]: r for r in catalog.QUERIES["pagerank_stationary"](spark, SF).collect()}
    assert all(found[i]["rank_plain"] == pytest.approx(plain[i], abs=2e-9) and found[i]["rank_trust"] == pytest.approx(trust[i], abs=2e-9) for i in nodes)
    groups = {}
    for i, c in nodes.items():
        groups.setdefault(c, []).append(plain[i] - trust[i])
    got = {r["community"]: r["mean_pagerank_drop_ppm"] for r in catalog.QUERIES["cci_scores"](spark, SF).collect()}
    assert set(got) == set(groups) and len(set(got.values())) > 1
    assert all(got[c] == pytest.approx(1e6 * sum(v) / len(v), abs=60) for c, v in groups.items())  # the index stops at a change of a millionth for each node


def test_moves_go_on_until_nothing_is_gained(spark):
    cliques = [(6 * g + a, 6 * g + b) for g in range(12) for a in range(6) for b in range(a)]
    ring = cliques + [(6 * g, (6 * g + 9) % 72) for g in range(12)]
    e, nodes = spark.createDataFrame(ring, "src long, dst long"), spark.range(72)
    value = lambda part: G.modularity(e, part).first()[0]
    few, whole = G.label_moves(e, nodes, levels=1, rounds=3), G.label_moves(e, nodes, levels=None, rounds=None, local_links=0)
    local = G.label_moves(e, nodes, levels=None, rounds=None)
    named = G.label_moves(e.selectExpr("concat('n', src) src", "concat('n', dst) dst"), nodes.selectExpr("concat('n', id) id"), levels=None, rounds=None, local_links=0)
    cut = spark.createDataFrame([(i, i // 6) for i in range(72)], "id long, community long")
    assert min(value(whole), value(local)) >= value(cut) - 1e-6 > value(few)
    assert G.modularity(e.selectExpr("concat('n', src) src", "concat('n', dst) dst"), named).first()[0] >= value(cut) - 1e-6
    assert all(r["community"] <= r["id"] for r in local.collect())  # named by the least node
    again = G.label_moves(e, nodes, levels=None, rounds=None)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, local.collect()))


def test_snowball_follows_long_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(24)], "src long, dst long")
    assert G.snowball(chain, spark.range(1), 100, 42).count() == 25


def test_bfs_follows_long_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(54)], "src long, dst long")
    assert {r["id"]: r["distance"] for r in G.bfs(chain, spark.range(1), directed=True).collect()} == {k: k for k in range(55)}


def plain_reach(arcs, start):
    seen, stack = {start}, [start]
    while stack:
        for b in arcs.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def test_strong_components_and_bow_tie_equal_plain_ones(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(34)} | {(50, 51), (51, 52), (52, 50), (52, 53), (54, 50), (60, 60)}
        ids = [*range(30), *range(50, 56), 60, 70]
        e, nodes = spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.createDataFrame([(i,) for i in ids], "id long")
        ahead, back = {}, {}
        for a, b in pairs:
            ahead.setdefault(a, set()).add(b), back.setdefault(b, set()).add(a)
        down, up = {i: plain_reach(ahead, i) for i in ids}, {i: plain_reach(back, i) for i in ids}
        strong = {i: min(down[i] & up[i]) for i in ids}
        assert {r["id"]: r["component"] for r in G.strong_components(e, nodes).collect()} == strong
        core_name = min(set(strong.values()), key=lambda c: (-list(strong.values()).count(c), c))
        core = {i for i in ids if strong[i] == core_name}
        both = {i: ahead.get(i, set()) | back.get(i, set()) for i in ids}
        weak = {i: min(plain_reach(both, i)) for i in ids}
        linked = [w for i, w in weak.items() if both[i] - {i}]
        giant = min(set(linked), key=lambda c: (-linked.count(c), c))
        want = {i: "core" if i in core else "in" if down[i] & core else "out" if up[i] & core else "tendril" if weak[i] == giant and both[i] - {i} else "apart" for i in ids}
        assert {r["id"]: r["part"] for r in G.bow_tie(e, nodes).collect()} == want
    assert G.strong_components(e.limit(0), nodes).count() == len(ids)


def test_power_law_fit():
    import collections

    import numpy as np

    rng = np.random.default_rng(2)
    law = collections.Counter(rng.zipf(2.5, 20_000).tolist())
    fit = G.power_law_fit(list(law.items()))
    assert fit["alpha"] == pytest.approx(2.5, abs=0.05) and fit["xmin"] <= 3 and fit["ks"] < 0.02
    normal = collections.Counter(np.maximum(1, np.round(np.exp(rng.normal(3, 0.4, 20_000)))).astype(int).tolist())
    bent = G.power_law_fit(list(normal.items()), least_tail=15_000)
    assert bent["ratio"] < -5 and bent["p"] < 1e-3 and fit["ratio"] > bent["ratio"]
    assert np.isnan(G.power_law_fit([(1, 5)])["alpha"]) and np.isnan(G.power_law_fit([])["alpha"])
    assert G._zeta(2.0, 1) == pytest.approx(np.pi**2 / 6, abs=1e-9) and G._zeta(3.0, 5) == pytest.approx(sum(k**-3.0 for k in range(5, 200_000)), abs=1e-8)


def test_small_graph_operators(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9), (2, 1)], "src long, dst long")
    got = {r["id"]: (r["out"], r["into"]) for r in G.adjacency(e).collect()}
    assert got[3] == ([1, 4], [2]) and got[4] == ([], [3]) and got[2] == ([1, 3], [1])
    assert tuple(G.mean_path(e, spark.range(10)).first()) == (4, pytest.approx((6 * 1 + 2 * 1 + 4 * 2) / 12))
    assert [tuple(r) for r in G.closed_triads(e).collect()] == [(1, 2, 1)]
    both = G.random_pairs(200, 0.1, 3, spark, directed=True).collect()
    assert len(set(map(tuple, both))) == len(both) and all(r["a"] != r["b"] for r in both) and 3500 < len(both) < 4500
    with pytest.raises(ValueError):
        most, G.MOST_ARCS = G.MOST_ARCS, 3
        try:
            G.betweenness(e, spark.range(10), 2)
        finally:
            G.MOST_ARCS = most


def test_ranks_within_groups_need_no_task_for_a_group(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 3) for k in range(50)], "k long, g long")
    got = R.ranked_within(rows, "g", F.desc("k")).collect()
    for r in got:
        mine = sorted((x["k"] for x in got if x["g"] == r["g"]), reverse=True)
        assert r["place"] == mine.index(r["k"]) + 1 and r["group_size"] == len(mine)


def test_paths_between_in_tables_equal_those_of_workers(spark, monkeypatch):
    rng = np.random.default_rng(1)
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2))], "src long, dst long")
    held = {r["id"]: r["betweenness"] for r in G.betweenness(e, spark.range(32), 20).collect()}
    monkeypatch.setattr(G, "MOST_ARCS", 3)
    got = {r["id"]: r["betweenness"] for r in G.betweenness(e, spark.range(32), 20, tables=True).collect()}
    assert got == pytest.approx(held) and len(got) == 32 and max(held.values()) > 0


def test_communities_by_component_stay_inside(spark):
    """A graph above local_links whose components aren't: no rounds, and no community reaches beyond a component."""
    rng = np.random.default_rng(2)
    one = [(int(a), int(b)) for a, b in rng.integers(0, 20, (60, 2))]
    e = spark.createDataFrame([(a + 100 * k, b + 100 * k) for k in range(3) for a, b in one], "src long, dst long")
    part = G.label_moves(e, e.selectExpr("src id").union(e.selectExpr("dst id")).distinct(), levels=None, rounds=None, local_links=100)
    rows = part.collect()
    assert all(r["community"] // 100 == r["id"] // 100 for r in rows) and len({r["id"] for r in rows}) == len(rows)
    assert G.modularity(e, part).first()[0] > 0.6


def test_mean_clustering_is_that_of_all_nodes(spark):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2))], "src long, dst long")
    want = G.local_clustering(e, spark.range(35)).agg(F.sum("degree"), F.avg("clustering")).first()
    assert G.mean_clustering(e, 35) == (want[0] // 2, pytest.approx(want[1]))


def test_first_and_quota_rows_are_those_of_a_full_sort(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(400)], "k long, g string")
    code = R.draw("k", 5)
    every = [r["k"] for r in rows.orderBy(code, "k").collect()]
    for n in (0, 1, 37, 400, 500):
        assert sorted(r["k"] for r in R.first_by(rows, code, ("k",), n).collect()) == sorted(every[:n])
    some = R.quota_sample(rows, "k", "g", {"a": 30, "b": 20}, 5)
    assert sorted(r["k"] for r in some.collect()) == sorted([k for k in every if k % 3][:30] + [k for k in every if k % 3 == 0][:20])
    assert "Window" not in R.quota_sample(rows, "k", "g", {"a": 30, "b": 20}, 5)._jdf.queryExecution().optimizedPlan().toString().split("GlobalLimit")[-1]
