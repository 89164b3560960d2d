"""The small-graph profile, stability, the student, readers and sinks."""

import collections
import json

import numpy as np
import pytest
from graphtrust.functions import prompts
from graphtrust.operators import prototype as O
from graphtrust.operators import stability as B
from graphtrust.operators import student as T
from graphtrust.sources import readers, sinks
from pyspark.sql import functions as F



def giant(pairs, nodes):
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    best, seen = 0, set()
    for n in nodes:
        stack, size = [n], 0
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                size += 1
                stack += near[x]
        best = max(best, size)
    return best


def test_removal_curve(spark):
    rng = np.random.default_rng(4)
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (40, 2))})
    e = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in links], "edge_id string, src long, dst long")
    nodes = spark.range(30)
    targets = e.filter("src < 20")
    import hashlib

    drawn = sorted((r["edge_id"] for r in targets.collect()), key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())
    order = {k: n for n, k in enumerate(drawn, 1)}
    for r in O.removal_curve(e, nodes, targets, steps=5, sources=2).collect():
        gone = {frozenset(map(int, k.split("-"))) for k, n in order.items() if n <= r["removed"]}
        left = [p for p in links if p[0] != p[1] and frozenset(p) not in gone]
        assert r["giant_share"] == pytest.approx(giant(left, range(30)) / 30), r
        assert r["removed"] == int(r["step"] / 4 * len(order)) and (r["mean_path"] or 1) >= 1


def test_stability_and_models(spark):
    blocks = [(a, b) for g in range(4) for a in range(g * 6, g * 6 + 6) for b in range(g * 6, g * 6 + 6) if a != b] + [(0, 6), (6, 12), (12, 18)]
    rows = [(f"{a}-{b}", a, b, "Method", 1.0, 0.5, True) for a, b in blocks]
    e = spark.createDataFrame(rows, "edge_id string, src long, dst long, intent string, weight double, confidence double, typed boolean")
    nodes = spark.range(24)
    first, other = B.seed_stability(e, nodes, (1, 2), levels=1).orderBy("seed").collect()
    assert first["spearman"] in (0.0, 1.0) and first["overlap"] == 1.0 and other["compared"] >= 1
    m = B.modularity_significance(e, nodes, nulls=2, levels=1).first()
    assert m["modularity"] > 0.5 and m["z"] > 0
    grown = B.preferential_pairs(spark, 2000, 3, 7).toPandas()
    assert (grown["a"] < grown["b"]).all() and grown["b"].max() < 2000 and not grown.duplicated().any() and len(grown) > 5000
    degree = np.bincount(np.concatenate([grown["a"], grown["b"]]))
    assert degree.max() > 8 * degree.mean() and degree[:50].mean() > 3 * degree[-1000:].mean()
    assert sorted(map(tuple, grown.to_numpy())) == sorted(map(tuple, B.preferential_pairs(spark.newSession(), 2000, 3, 7).toPandas().to_numpy()))


def test_student(spark):
    words = {"Method": "uses tool data", "Background": "context prior work", "Support": "claim evidence holds"}
    rows = spark.createDataFrame([(f"{text} {k}", name) for name, text in words.items() for k in range(20)] + [(None, "Support"), ("x", "unknown")], "text string, label string")
    model = T.fit_student(rows, rounds=10)
    got = T.infer(model, spark.createDataFrame([(t,) for t in words.values()] + [(None,)], "text string")).collect()
    assert [r["student_label"] for r in got[:3]] == list(words) and all(0 < r["student_confidence"] <= 1 for r in got)
    judged = T.infer(model, rows.filter("label <> 'unknown'"))
    assert 0.9 < T.macro_f1(judged, "label", "student_label") <= 1
    best, decay, score = T.fit_best(rows, rows.filter("label <> 'unknown'"), decays=(10.0, 1e-3), rounds=10)
    assert decay == 10.0 and score > 0.9  # both judge alike, so the first stands
    long = spark.createDataFrame([("word " * 300 + "tool",), (None,)], "text string").select(T.bounded("text", 256).alias("t")).collect()
    assert [len(r["t"].split()) for r in long] == [256, 0]
    with pytest.raises(ValueError):
        T.fit_student(rows, least=21)
    with pytest.raises(ValueError):
        T.fit_student(rows.limit(0))


def test_readers(spark, tmp_path):
    paper = {"id": "1", "title": "t", "references": ["2", None, "2"], "fos": [{"name": "x", "w": 0.5}], "indexed_abstract": {"IndexLength": 1, "InvertedIndex": {"a": [0]}}}
    (tmp_path / "a.json").write_text(json.dumps([paper, {"id": "2"}], indent=1))
    (tmp_path / "r.json").write_text(json.dumps({"root": [paper, {"id": "2"}]}))
    (tmp_path / "l.jsonl").write_text(json.dumps(paper) + "\n\n  \n" + json.dumps({"id": "2"}) + "\n")
    sets = [readers.papers(spark, str(tmp_path / "a.json"), lines=False), readers.papers(spark, str(tmp_path / "r.json"), root="root"), readers.papers(spark, str(tmp_path / "l.jsonl")).filter("id is not null")]
    for rows in sets:
        assert sorted(r["id"] for r in rows.collect()) == ["1", "2"]
        assert [tuple(r) for r in readers.paper_references(rows).collect()] == [("1", "2")] * 2
    lines = readers.json_lines(spark, str(tmp_path / "l.jsonl")).select("line_no", F.try_variant_get("doc", "$.id", "string").alias("id")).orderBy("line_no").collect()
    assert [tuple(r) for r in lines] == [(1, "1"), (4, "2")]
    (tmp_path / "bad.jsonl").write_text("{}\n{no\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "g.graphml").write_text('<graphml><graph edgedefault="directed"><node id="7"/><node id="8"/><edge source="7" target="8"/></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(r["id"] for r in nodes.collect()) == ["7", "8"] and [tuple(r) for r in edges.collect()] == [("7", "8")]
    with pytest.raises(ValueError, match="nothing"):
        readers.require(nodes, "id", "nothing")


def test_sinks(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    sinks.write_table(rows.coalesce(1), str(tmp_path / "t"), rows_per_file=30)
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 4 and spark.read.parquet(str(tmp_path / "t")).count() == 100
    runs = []
    double = lambda df: runs.append(df.count()) or df
    folder = str(tmp_path / "r")
    assert sinks.resume(rows, folder, "id", double, batches=4, most=2) == 2
    assert sinks.resume(rows, folder, "id", double, batches=4) == 2 and sinks.resume(rows, folder, "id", double) == 0
    assert sum(runs) == 100 and spark.read.parquet(folder).distinct().count() == 100
    (tmp_path / "shards").mkdir()
    for k in (0, 1):
        rows.limit(5).toPandas().to_parquet(tmp_path / "shards" / f"part_{k:04d}.parquet")
    (tmp_path / "shards" / "part_0002.parquet").write_bytes(b"broken")
    got = readers.shards(spark, str(tmp_path / "shards"), skip_corrupt=True)
    assert got.count() == 10 and got.select("source_path").distinct().count() == 2
    sinks.write_report(rows.limit(3), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text().splitlines() == ["id,v", "0,0", "1,2", "2,4"]
    sinks.write_json_lines(spark.sql("select 1 a, cast(null as string) b"), str(tmp_path / "j"))
    assert json.loads(next((tmp_path / "j").glob("*.txt")).read_text()) == {"a": 1, "b": None}
    sinks.write_manifest(spark, {"rows": 100}, str(tmp_path / "m"))
    assert json.loads("\n".join(p.read_text() for p in (tmp_path / "m").glob("*.txt")))["rows"] == 100
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    row = sinks.file_digests(spark, str(tmp_path / "f")).first()
    assert row["length"] == 3 and row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_requests(spark):
    text = prompts.prompt(F.lit("A"), F.lit("two\n lines"), F.lit(None), F.lit("B"))
    row = spark.range(1).select(prompts.request(F.lit("e1"), text, "m").alias("r")).first()
    doc = json.loads(row["r"])
    assert doc["custom_id"] == "e1" and "Citing abstract: two lines\nCited title: \n" in doc["body"]["messages"][0]["content"]


def test_loaders_and_stats(spark, tmp_path):
    raw = spark.createDataFrame([(1, ["2", "9", None]), (2, ["1"]), (3, None)], "id long, references array<string>")
    assert tuple(readers.paper_stats(raw).first()) == (3, 4, 1, pytest.approx(4 / 3, abs=1e-6))
    got = {r["id"]: r["references"] for r in readers.papers_in(raw, spark.createDataFrame([(1,), (2,), (2,)], "id long")).collect()}
    assert got == {"1": ["2"], "2": ["1"]}
    (tmp_path / "old.json").write_text(json.dumps([{"text1": "a", "text2": "b", "label": 3, "source": "1", "target": "2"}]))
    assert tuple(readers.label_checkpoint(spark, str(tmp_path / "old.json")).first()) == ("a", "b", 3, "1", "2")
    shard = spark.createDataFrame([("e1", "Method", 1.0, 0.5), ("e2", "Support", 0.5, 0.25)], "edge_id string, predicted_label string, semantic_weight double, label_confidence double").toPandas()
    for k, folder in enumerate(("one", "two")):
        (tmp_path / folder).mkdir()
        shard.assign(predicted_label=f"Background{k}" if k else "Method").to_parquet(tmp_path / folder / "part_0000.parquet")
    spark.createDataFrame([("e2", "Support", 0.75), ("e3", "Background", None)], "edge_id string, label string, confidence double").write.parquet(str(tmp_path / "teacher"))
    folders, missing, teacher = [str(tmp_path / f) for f in ("one", "two")], str(tmp_path / "none"), str(tmp_path / "teacher")
    rows = {r["edge_id"]: r for r in readers.partial_semantics(spark, [missing, *folders], [teacher]).collect()}
    assert {k: (r["label"], r["weight"], r["confidence"]) for k, r in rows.items()} == {"e1": ("Method", 1.0, 0.5), "e2": ("Method", 0.5, 0.25), "e3": ("Background", 0.2, None)}
    assert {r["edge_id"] for r in readers.edge_ids(spark, [teacher], [missing, folders[0]]).collect()} == {"e1", "e2", "e3"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.edge_ids(spark, [missing])
    assert readers.row_count(spark, teacher) == 2
    row = readers.teacher_labels(spark, teacher).filter("edge_id = 'e2'").first()
    assert (row["weight"], row["model_version"], row["priority"]) == (0.5, "teacher", 10_000)
    with pytest.raises(ValueError, match="label"):
        readers.teacher_labels(spark, folders[0])


def test_canonical_tables(spark, tmp_path):
    from graphtrust.plans import canonical

    (tmp_path / "raw.json").write_text(json.dumps([
        {"id": "1", "title": None, "references": ["2", "2", "7", None], "fos": [{"name": "x", "w": 0.25}, {"name": "y", "w": 0.5}], "indexed_abstract": {"IndexLength": 4, "InvertedIndex": {"good": [1], "a": [0, 3]}}},
        {"id": "2", "title": "t", "n_citation": 3, "references": ["1"]}, {"title": "no id"},
    ]))
    papers, metadata, edges, manifest = canonical.canonical_tables(readers.papers(spark, str(tmp_path / "raw.json"), lines=False))
    got = {r["paper_id"]: r for r in papers.collect()}
    assert (got["1"]["title"], got["1"]["abstract"], got["1"]["n_citation"], got["1"]["top_fos"], got["1"]["out_reference_count_raw"]) == ("", "a good  a", 0, "y", 3)
    assert (got["2"]["abstract"], got["2"]["n_citation"], got["2"]["top_fos"]) == ("", 3, "Unknown") and metadata.columns == list(canonical.METADATA)
    assert sorted((r["citing_id"], r["cited_id"]) for r in edges.collect()) == [("1", "2"), ("1", "2"), ("2", "1")]
    assert tuple(manifest.first()) == (2, 3, 1.5)
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for reuse in (True, True, False):
        assert canonical.load_or_build(spark, str(tmp_path / "t"), build, reuse).count() == 3
    assert len(made) == 2


def test_chunk_files_and_progress(spark, tmp_path):
    rows = spark.createDataFrame([(k, json.dumps({"n": "x" * (k % 5)})) for k in range(20)], "k long, v string")
    parts = sorted(map(tuple, sinks.write_request_chunks(rows, str(tmp_path / "c"), "k", "v", 6, 70).collect()))
    for chunk, requests, size in parts:
        text = "".join(p.read_text() for p in (tmp_path / "c" / f"chunk={chunk}").glob("*.txt"))
        assert text.count("\n") == requests <= 6 and len(text.encode()) == size <= 70
    assert sum(r for _, r, _ in parts) == 20
    for k in range(2):
        sinks.append_progress(spark, {"epoch": k}, str(tmp_path / "p"))
    assert sorted(json.loads(x)["epoch"] for p in (tmp_path / "p").glob("*.txt") for x in p.read_text().splitlines()) == [0, 1]
    sinks.write_report(spark.range(9).orderBy("id"), str(tmp_path / "h"), head=2)
    assert next((tmp_path / "h").glob("*.csv")).read_text().splitlines() == ["id", "0", "1"]


def test_final_selection_raises_where_edges_are_short(spark):
    from graphtrust.operators import selection as X

    pools = spark.createDataFrame([(f"e{k}", p) for k in range(6) for p in ("dense", "random")], "edge_id string, pool string")
    got = X.by_quota(pools, (("dense", 0.5), ("random", 0.25)), 4, 1, "rest", 2)
    counts = collections.Counter(r["pool"] for r in got.collect())
    assert sum(counts.values()) == 4 and counts["dense"] == 2 and counts["random"] + counts["rest"] == 2
    with pytest.raises(ValueError, match="only 6"):
        X.by_quota(pools, (("dense", 0.5),), 9, 1, "rest", 2, strict=True)
