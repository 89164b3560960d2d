"""Node attacks, ranks over many tasks, rich club, GraphML, archives, batches and shard streams."""

import collections
import json
import tarfile
import xml.dom.minidom

import numpy as np
import pytest
from graphtrust.functions import stats
from graphtrust.operators import components as K
from graphtrust.operators import graph as G
from graphtrust.operators import ranking as R
from graphtrust.operators import resilience as C
from graphtrust.sources import batches, readers, sinks
from graphtrust.streaming import shards
from pyspark.sql import functions as F


def components(pairs, nodes):
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    left, out = set(nodes), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            x = stack.pop()
            part.add(x)
            stack += [y for y in near[x] if y in left]
            left -= near[x]
        out.append(part)
    return out, near


def hops(near, start, inside):
    seen, level, d = {start: 0}, [start], 0
    while level:
        d += 1
        level = [y for x in level for y in near[x] & inside if y not in seen and not seen.update({y: d})]
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(8)
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2))})
    return links, spark.createDataFrame(links, "src long, dst long"), spark.range(42)


def test_attack_curve_equals_plain_removal(graph):
    links, e, nodes = graph
    pairs = {(min(p), max(p)) for p in links if p[0] != p[1]}
    orders = C.attack_orders(e, nodes)
    number = {s: {r["id"]: r["number"] for r in o.collect()} for s, o in orders.items()}
    degree = collections.Counter(x for p in pairs for x in p)
    assert [i for i, _ in sorted(number["degree"].items(), key=lambda kv: kv[1])] == sorted(range(42), key=lambda i: (-degree[i], i))
    between = dict.fromkeys(range(42), 0.0)
    _, near = components(pairs, range(42))
    every = {i: hops(near, i, set(range(42))) for i in range(42)}

    def paths(a, b):
        return 1 if a == b else sum(paths(a, x) for x in near[b] if every[a].get(x) == every[a][b] - 1)

    count = {(a, b): paths(a, b) for a in every for b in every[a]}
    for a, b in count:
        for v in range(42):
            if v not in (a, b) and v in every[a] and b in every[v] and every[a][v] + every[v][b] == every[a][b]:
                between[v] += count[a, v] * count[v, b] / count[a, b]
    assert [i for i, _ in sorted(number["betweenness"].items(), key=lambda kv: kv[1])] == sorted(range(42), key=lambda i: (-round(between[i], 6), i))
    got = C.attack_curve(e, nodes, orders, steps=6, sources=50).collect()
    assert len(got) == 18 and {r["strategy"] for r in got} == set(orders)
    for r in got:
        gone = int(np.linspace(0, 0.95, 6)[r["step"]] * 42)
        alive = {i for i, n in number[r["strategy"]].items() if n > gone}
        parts, near = components([p for p in pairs if set(p) <= alive], alive)
        largest = max(map(len, parts))
        assert r["removed"] == gone and r["giant_share"] == pytest.approx(largest / 42), r
        means = []
        for part in parts:
            if len(part) == largest:
                d = [x for i in part for x in hops(near, i, part).values() if x]
                means.append(np.mean(d) if d else 0.0)
        assert any(r["mean_path"] == pytest.approx(m) for m in means), r
    assert C.attack_curve(e.limit(0), nodes.limit(0), {s: o.limit(0) for s, o in orders.items()}, steps=2).count() == 6


def test_searches_hold_a_row_for_each_node(graph):
    """However many start, one row a node and level; the graphs of several keys aren't copied."""
    links, e, nodes = graph
    pairs = sorted({(min(p), max(p)) for p in links if p[0] != p[1]})
    _, near = components(pairs, range(42))
    arcs = K.linked(e)
    assert sorted(map(tuple, arcs.select("src", "dst").collect())) == sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    reached = {}
    for d, rows, _ in G.waves(arcs, dict(enumerate(range(40)))):
        held = rows.collect()
        assert len(held) == len({r["id"] for r in held}) <= 40
        reached |= {(b, r["id"]): d for r in held for b in range(40) if r["f0"] >> b & 1}
    assert reached == {(s, i): d for s in range(40) for i, d in hops(near, s, set(range(42))).items() if d}
    spark = e.sparkSession
    marked = [(a, b, (a + b) % 4) for a, b in pairs]  # kind: a bit for each of two graphs
    got = C.health(spark.createDataFrame(marked, "a long, b long, kind int"), nodes, {5: 1, 9: 2}, 50).collect()
    for r in got:
        own = [(a, b) for a, b, kind in marked if kind & {5: 1, 9: 2}[r["key"]]]
        parts, near = components(own, range(42))
        largest = max(map(len, parts))
        first = min((p for p in parts if len(p) == largest), key=min)
        far = [x for i in first for x in hops(near, i, first).values() if x]
        assert (r["n_pairs"], r["components"], r["giant"]) == (len(own), len(parts), largest) and r["mean_path"] == pytest.approx(np.mean(far), abs=1e-6)


def test_ranks_and_medians(spark):
    values = [3, 1, 3, 2, 3, 1, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values[:-1])], "id long, v long")
    got = {r["id"]: r["place"] for r in R.ranks(rows, "v", "place").collect()}
    assert got == {k: 1 + sum(w > v for w in values[:-1]) for k, v in enumerate(values[:-1])}
    numbers = R.prefix_sums(spark.range(1000).repartition(7), F.col("id"), F.desc("id")).collect()
    assert all(r["before"] == sum(range(r["id"] + 1, 1000)) for r in numbers)
    for some in ([1], [1, 2], [5, 1, 1], [4, 1, 2, 2], [9, 7, 5, 3, 1, 1]):
        df = spark.createDataFrame([(x,) for x in some], "x long")
        assert df.agg(stats.upper_median("x").alias("m")).first()["m"] == sorted(some)[len(some) // 2]


def test_rich_club_and_topology(graph):
    links, e, nodes = graph
    pairs = {(min(p), max(p)) for p in links if p[0] != p[1]}
    degree = collections.Counter(x for p in pairs for x in p)
    for r in C.rich_club(e).collect():
        rich = {i for i, d in degree.items() if d > r["degree"]}
        held = sum(set(p) <= rich for p in pairs)
        assert (r["nodes"], r["pairs"]) == (len(rich), held) and r["rich_club"] == pytest.approx(2 * held / (len(rich) * (len(rich) - 1)), abs=1e-6)
    row = C.topology_baseline(e, nodes, sources=100).first()
    parts, near = components(pairs, range(42))
    inside = max(parts, key=len)
    every = [hops(near, i, inside) for i in inside]
    assert row["mean_path"] == pytest.approx(np.mean([d for h in every for d in h.values()]), abs=1e-6)
    assert 0 < row["diameter"] <= max(d for h in every for d in h.values()) and row["density"] == pytest.approx(len(links) / (42 * 41))
    linked = lambda i: sum(y in near[x] for x in near[i] for y in near[i]) / (len(near[i]) * (len(near[i]) - 1))
    assert row["mean_clustering"] == pytest.approx(np.mean([linked(i) if len(near[i]) > 1 else 0.0 for i in inside]), abs=1e-6)


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a&<b>", 'say "x"', 3), ("c", None, None)], "id string, title string, n long")
    edges = spark.createDataFrame([("a&<b>", "c", 0.5, "Method")], "src string, dst string, weight double, intent string")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    (file,) = (tmp_path / "g").glob("*.txt")
    doc = xml.dom.minidom.parseString(file.read_bytes())
    assert [k.getAttribute("attr.type") for k in doc.getElementsByTagName("key")] == ["string", "long", "double", "string"]
    assert [d.firstChild.data for d in doc.getElementsByTagName("data")] == ['say "x"', "3", "0.5", "Method"]
    got, links = readers.graphml(spark, str(file))
    assert sorted(r["id"] for r in got.collect()) == ["a&<b>", "c"] and [tuple(r) for r in links.collect()] == [("a&<b>", "c")]


def test_package_and_config(spark, tmp_path):
    (tmp_path / "out" / "deep").mkdir(parents=True)
    (tmp_path / "out" / "a.csv").write_text("x")
    (tmp_path / "out" / "deep" / "b.json").write_text("{}")
    made = sinks.package(spark, [str(tmp_path / "out")], str(tmp_path / "p.tar.gz"), ["a.csv", "c.csv"])
    assert made["missing"] == ["c.csv"] and [(f["path"], f["bytes"]) for f in made["files"]] == [("out/a.csv", 1), ("out/deep/b.json", 2)]
    with tarfile.open(tmp_path / "p.tar.gz") as archive:
        assert archive.extractfile("out/a.csv").read() == b"x" and json.load(archive.extractfile("manifest.json")) == made
    (tmp_path / "c.yaml").write_text("cap: 5\n")
    (tmp_path / "e.yaml").write_text("")
    assert readers.config(str(tmp_path / "c.yaml")) == {"cap": 5} and readers.config(str(tmp_path / "e.yaml")) == {}


def test_batches(spark, tmp_path, monkeypatch):
    path = tmp_path / "requests.jsonl"
    path.write_text("{}\n\n  \n{}\n")
    prices = batches.Prices(1000, 100, 0.5, 2.0)

    class Fake:
        states = ["validating", "in_progress", "completed"]

        def submit(self, path):
            return "b1"

        def status(self, batch):
            return self.states.pop(0)

        def fetch(self, batch, path):
            open(path, "w").write('{"custom_id": "e1"}\n')

    assert batches.submit(spark, str(path), prices, 1.0) == {"path": str(path), "requests": 2, "cost": pytest.approx(0.0014), "cap": 1.0, "executed": False}
    with pytest.raises(batches.OverCap):
        batches.submit(spark, str(path), prices, 0.001, Fake())
    fake = Fake()
    assert batches.submit(spark, str(path), prices, 1.0, fake)["batch"] == "b1"
    assert batches.retrieve(fake, "b1", str(tmp_path / "r"), most=2, sleep=lambda s: None) == "in_progress" and not (tmp_path / "r").exists()
    assert batches.retrieve(fake, "b1", str(tmp_path / "r")) == "completed" and (tmp_path / "r").exists()
    monkeypatch.setenv("GRAPHTRUST_TEST", "")
    with pytest.raises(RuntimeError):
        batches.required("GRAPHTRUST_TEST")


def test_shard_stream_takes_each_shard_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda k: spark.range(k * 10, k * 10 + 10).toPandas().to_parquet(tmp_path / "in" / f"part_{k:04d}.parquet")
    put(0), put(1)
    (tmp_path / "in" / "other.parquet").write_bytes(b"not a shard")
    run = lambda: shards.process_shards(spark, str(tmp_path / "in"), "id long", lambda df: df.withColumn("v", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "state"), files=1).awaitTermination()
    run(), run()
    put(2)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(k, 2 * k) for k in range(30)]
