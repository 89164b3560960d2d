"""Each operator against brute force, round trips or held-out labels, and on degenerate tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from graphtrust.llm import licences, mixing, mpeg, packing, pii, quality, simhash, substrings, urlrules, voronoi
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(None, "null id"), (1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "same words here. " * 3000), (5, " \n\t ")]
SCHEMA = "doc_id long, text string, id string, txt int, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, s) for (i, t), s in zip(ODD, [None, "", "b", "b", "a", None, "a"])], SCHEMA)


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1_equals_all_pairs(docs, odd):
    for table in (docs, odd, odd.limit(0)):
        got = simhash.near_duplicate_classes(table, width=3, words=1, radius=3, distinct=False).collect()
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in table.collect()]
        label = {k: k for k in range(len(rows))}
        moved = True
        while moved:
            moved = False
            for a in label:
                for b in label:
                    if label[b] < label[a] and (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                        label[a], moved = label[b], True
        least = collections.defaultdict(list)
        for k, (i, _) in enumerate(rows):
            least[label[k]] += [i] if i is not None else []
        want = sorted((str(i), f"{fp:016x}", str(min(least[label[k]], default=None))) for k, (i, fp) in enumerate(rows))
        assert sorted((str(r["id"]), r["fp"], str(r["component_id"])) for r in got) == want


def test_op1_forest_keeps_links_between_blocks():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    forest = simhash.links_within(base[:, None], near[:, None], 3)
    assert len(forest) == 300 and set(map(tuple, forest)) == {(300 + k, k) for k in range(300)}
    big = simhash.plan_blocks({k: 20_000 for k in range(20, 44)}, 3)
    assert max(n for _, _, n, _, _ in big) >= 2 and all(high - low < 20 for _, _, _, low, high in big)  # no block holds more than BLOCK_ROWS
    plan = simhash.plan_blocks({20: 5, 30: 100, 33: 2, 50: 1}, 3)
    assert [r[0] for r in plan] == [20, 30, 33, 50] and plan[1][2] > 1 and plan[1][4] >= plan[2][1]


def test_near_copies_by_shared_shingles_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    notice = [word() for _ in range(60)]
    texts = []
    for k in range(300):
        base = [word() for _ in range(rng.choice((8, 30, 120, 400)))]
        body = base + (notice if k % 3 else [])  # two of three share 60 words or more
        texts.append(" ".join(body))
        for _ in range(rng.randrange(3)):
            near = list(body)
            near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    rows = [(i, t) for i, t in enumerate(texts + texts[:40] + [""] * 3)] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, simhash.near_duplicate_classes(docs).collect()))
    assert 300 < len(set(want)) and len({r.split("component_id=")[1] for r in want}) < len(texts)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 500)
    for most in (simhash.BLOCK_ROWS, 50):  # at 50 the notice's shingles are no bucket's
        monkeypatch.setattr(simhash, "BLOCK_ROWS", most)
        assert sorted(map(str, simhash.near_duplicate_classes(docs, sketch=simhash.SKETCH).collect())) == want
    assert simhash.near_duplicate_classes(docs.limit(0), sketch=simhash.SKETCH).collect() == []


def test_near_copies_links_of_groups_and_what_sketches_leave_out():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**63, (400, 4), dtype=np.uint64)
    fps[200:] = fps[:200] ^ np.uint64(5)
    for keys in (np.arange(400) % 200, np.arange(400) % 2, np.zeros(400), np.arange(400) % 8):
        forest = simhash.shared_links(keys.astype(np.uint64), fps, 64)
        assert {tuple(sorted(x)) for x in forest.tolist()} == {(k, k + 200) for k in range(200)}
    assert not len(simhash.shared_links(np.arange(400).astype(np.uint64), fps, 64))  # no shingle is shared, so none is compared
    for _ in range(50):
        pool = np.sort(rng.choice(2**40, 90, replace=False)).astype(np.uint64)
        pair = [np.sort(rng.choice(pool, rng.integers(1, 65), replace=False)) for _ in range(2)]
        frequent = np.sort(rng.choice(pool, 30, replace=False))
        owner, left = simhash.prefixes([x.astype("<u8").tobytes() for x in pair], frequent, rng.integers(4, 90, 30))
        assert [int((owner == k).sum()) for k in (0, 1)] == [len(x) - len(x) // simhash.SHARED for x in pair]
        if len(np.intersect1d(*pair)) > max(len(x) // simhash.SHARED for x in pair):
            assert len(np.intersect1d(left[owner == 0], left[owner == 1]))


def test_near_copies_work_follows_the_rows():
    rng = random.Random(9)
    notice = " ".join(f"n{k}" for k in range(8))  # four shingles in every text
    sketches = []
    for _ in range(2000):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + f" {notice}"
        sketches.append(np.unique(simhash.shingle_hashes(text.encode(), 5))[: simhash.SKETCH])
    hashes, counts = np.unique(np.concatenate(sketches), return_counts=True)
    often = counts > 3
    _, left = simhash.prefixes([x.astype("<u8").tobytes() for x in sketches], hashes[often], counts[often])
    met = np.unique(left, return_counts=True)[1].astype(np.int64)
    assert (met * (met - 1) // 2).sum() < len(sketches)  # two million pairs in all


def test_near_copies_short_texts_meet_none_by_chance(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    # two shingles set a quarter of the bits, so half of such texts were linked to the empty text, and all of these one class
    texts = [""] + [" ".join(f"t{k}x{j}" for j in range(6)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.near_duplicate_classes(docs).select("component_id").distinct().count() < len(texts)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == list(range(len(texts)))


def test_op2_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)] + [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (600, [0.5] * 8), (601, [0.5] * 8), (700, [1.0]), (None, [1.0] * 8)]
    again = [(100, vectors[100][1])] * 13 + [(200, vectors[7][1]), (600, [0.25] * 8), (700, [2.0]), (800, [])] + [(7, vectors[7][1])] * 12  # rows and ids that repeat
    for rows, pivots in ((vectors, 5), (vectors + again, 5), (vectors + again, None)):
        df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, id int, dim string, row int")
        got = voronoi.top_k(voronoi.integer_vectors(df), F.pmod("id", F.lit(100)) == 0, pivots=pivots).collect()
        ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and not any(x != x for x in v)]
        want = []
        for r, (q, v) in enumerate(ints):
            if q % 100 == 0:
                scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for o, (i, w) in enumerate(ints) if o != r and len(w) == len(v))[:10]
                want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert voronoi.top_k(voronoi.integer_vectors(df.limit(0)), F.lit(True)).count() == 0


def test_op2_groups_hold_every_true_best():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pivots = rng.normal(size=(5, 3))
        v = np.concatenate([rng.normal(size=(40, 3)), pivots])
        grp = ((v[:, None] - pivots) ** 2).sum(axis=2).argmin(axis=1)
        dist = np.sqrt(((v - pivots[grp]) ** 2).sum(axis=1))
        import pandas as pd

        frame = pd.DataFrame({"grp": range(5), "radius": [dist[grp == g].max() for g in range(5)], "near": [sorted(dist[grp == g])[:3] for g in range(5)]})
        pairs = set(voronoi._group_pairs(pivots, frame, frame, 2))
        for q in range(len(v)):
            s = v @ v[q]
            s[q] = -np.inf
            assert all((grp[q], grp[x]) in pairs for x in np.argsort(-s)[:2])


def naive_base(text):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        found += [(*m.span(), "card")] if 14 <= len(d) <= 19 and total % 10 == 0 else []
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_op3_patterns_equal_the_plain_ones(docs):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab@.-+ 0123456789()%é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == naive_base(text)
    for r in docs.collect():
        assert pii.base_spans(r["text"]) == naive_base(r["text"])


def test_op3_skip_links_add_spans_and_keep_base(spark, odd):
    rows = [(k, f"call +1 (771) 555-{1000 + k} today. word number {k} in 2020. mail me at user{k}@mail.example.com or 10.0.0.{k % 250}, that is user{k}@mail.example.com", "s") for k in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string, source string")
    field = pii.train(train)
    assert np.trace(field.skip) > 0  # a repeated token tends to have the label of its first place
    base, spans = pii.find_spans("write to joe@mail.example.com or joe@mail.example.com.", field)
    assert set(base) <= set(spans) and len(base) == 2
    got = pii.detect(odd, field=field).collect()
    assert len(got) == len(ODD) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    masked = pii.redact(train, field=field).filter("doc_id = 3").first()["text"]
    assert "555" not in masked and "<phone>" in masked and "<email>" in masked
    assert pii.redact(odd, field=field).filter("text is null").count() == 1
    assert pii.detect(odd.limit(0)).count() == 0


def test_op3_field_is_exact_on_chains_and_close_on_loops():
    rng, k = np.random.default_rng(0), 5
    for partner in ([0, 1, 2, 3, 4], [0, 1, 2, 0, 4], [0, 0, 1, 3, 0]):
        for _ in range(5):
            chain, skip = rng.normal(size=(k, k)), rng.normal(size=(k, k)) / 2
            field = pii.Field(rng.normal(size=(pii.BUCKETS + 1, k)), chain, skip + skip.T)
            tokens = pii.Tokens([(i, i + 1) for i in range(5)], [[3 * i, 3 * i + 1] for i in range(5)], partner)
            unary = [field.local[f].sum(axis=0) + field.local[pii.BUCKETS] for f in tokens.features]
            want = np.zeros((5, k))
            for y in itertools.product(range(k), repeat=5):
                score = sum(unary[i][y[i]] for i in range(5)) + sum(chain[y[i], y[i + 1]] for i in range(4)) + sum(field.skip[y[p], y[i]] for i, p in enumerate(partner) if p != i)
                for i in range(5):
                    want[i, y[i]] += np.exp(score)
            want /= want.sum(axis=1, keepdims=True)
            off = np.abs(pii.marginals(tokens, field) - want).max()
            assert off < (1e-9 if partner == [0, 1, 2, 3, 4] else 0.25)
    long = pii.Tokens([(i, i + 1) for i in range(20_000)], [[i % 7] for i in range(20_000)], list(range(20_000)))
    assert np.isfinite(pii.marginals(long, field)).all()


def test_op3_features_read_whole_tokens_and_words():
    a, b = ("1" + "-a" * 40 + end for end in ("-9", "+x"))
    assert pii._shape(a) != pii._shape(b) and pii.candidates(a).features != pii.candidates(b).features
    far = lambda w: pii.candidates(w + " " * 40 + "12345").features
    assert far("Call") != far("call") and far("x" * 60 + "Y") == far("x" * 90 + "Y") and far("") != far("call")


def plain_spans(text, label):
    """Diagonal voting over all k-grams of a text, in plain Python."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = []
    for template in licences.TEMPLATES[label]:
        t = template.split()
        hits = collections.defaultdict(list)
        for p in range(len(words) - 2):
            for q in range(len(t) - 2):
                if words[p : p + 3] == t[q : q + 3]:
                    hits[p - q].append((p, q))
        run, spans = None, []
        for d in sorted(hits):
            first, last = min(p for p, _ in hits[d]), max(p for p, _ in hits[d]) + 3
            if run and d - run[3] <= 3 and max(last, run[1]) - min(first, run[0]) <= 1.5 * len(t):
                run[:] = min(first, run[0]), max(last, run[1]), run[2] | {q for _, q in hits[d]}, d
            else:
                run = [first, last, {q for _, q in hits[d]}, d]
                spans.append(run)
        out += [(a, b, label, len(q) / (len(t) - 2)) for a, b, q, _ in spans if len(q) >= 0.75 * (len(t) - 2) and b - a <= 1.5 * len(t)]
    return out


def test_op4_equals_plain_diagonal_voting(spark, odd):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(rng.choice(list(licences.TEMPLATES.values()))).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(["so", "the", "software", "X"])] * rng.randrange(3)
            parts.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in words))
        rows.append((k, (", " if k % 2 else " filler words (c) 2020 ").join(parts) * (40 if k == 5 else 1), "a", 7))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, label string, row int")
    got = licences.license_labels(df).collect()
    assert len(got) == 63
    for r in got:
        want = sorted(s for label in licences.TEMPLATES for s in plain_spans(rows[r["id"]][1], label))
        assert [tuple(s) for s in r["license_spans"]] == want
        assert set(r["labels"].split(",")) - {""} == {s[2] for s in want} | (set(r["base_labels"].split(",")) - {""})
        assert r["score"] == (1.0 if r["n_base"] else max((s[3] for s in want), default=0.0))


def test_op4_base_places_and_templates(spark, odd):
    rows = [(1, "x CC-BY, cc by. All rights reserved"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under the new apache license version 2 0 x"), (4, "free software"), (5, "ALL RIGHTS RESERVED " * 500)]
    got = {r["id"]: r for r in licences.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 5, "cc-by,reserved")
    assert got[2]["labels"] == "apache-2.0" and got[2]["score"] == 1 and got[2]["base_labels"] == ""
    assert got[4]["labels"] == "" and got[4]["score"] == 0 and got[5]["n_base"] == 500
    assert got[3]["license_spans"] == [] and got[3]["score"] == 0  # one word put in breaks two of six 3-grams
    assert len(licences.license_labels(odd).collect()) == len(ODD) and licences.license_labels(odd.limit(0)).count() == 0


def test_op5_agrees_with_held_out_labels(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs).join(labels, F.col("id") == F.col("doc_id")).collect()
    assert np.mean([r["keep"] == bool(r["quality"]) for r in got]) > 0.97
    assert np.mean([r["keep"] for r in got if r["quality"]]) > 0.995
    assert quality.score(odd).count() == len(ODD) and quality.score(odd.limit(0)).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def plain_em(counts):
    """Posteriors by expectation-maximisation, vote by vote."""
    rows = [([c // 3**k % 3 for k in range(quality.LABELLERS)], n) for c, n in sorted(counts.items())]
    good = [0.1 if 1 in v else 0.95 for v, _ in rows]
    for _ in range(quality.EM_ROUNDS):
        total = sum(n for _, n in rows)
        prior = [(sum(n * (g if c else 1 - g) for (_, n), g in zip(rows, good)) + 1) / (total + 2) for c in (0, 1)]
        like = [[1.0, 1.0] for _ in rows]
        for k in range(quality.LABELLERS):
            for c in (0, 1):
                seen = {x: sum(n * (g if c else 1 - g) for (v, n), g in zip(rows, good) if v[k] == x) for x in (1, 2)}
                for r, (v, _) in enumerate(rows):
                    if v[k]:
                        like[r][c] *= (seen[v[k]] + 0.5) / (seen[1] + seen[2] + 1)
        good = [prior[1] * b / (prior[0] * a + prior[1] * b) for a, b in like]
    return dict(zip(sorted(counts), good))


def test_op5_posteriors_and_scorer_equal_plain_ones(spark, docs):
    profiled = quality.profiles(docs)
    counts = {r["pattern"]: r["count"] for r in profiled.groupBy("pattern").count().collect()}
    good, w = quality.train(profiled)
    want = plain_em(counts)
    assert good.keys() == want.keys() and all(good[c] == pytest.approx(want[c], abs=1e-9) for c in good)
    sample = sorted(profiled.collect(), key=lambda r: (r["draw"], r["id"]))[: quality.SAMPLE_DOCS]
    plain, squares = np.zeros(quality.BUCKETS + 1), np.full(quality.BUCKETS + 1, 1e-8)
    y = [good[r["pattern"]] for r in sample]
    weight = [t / max(sum(y), 1) + (1 - t) / max(len(y) - sum(y), 1) for t in y]
    for _ in range(quality.FIT_ROUNDS):
        slope = 1e-6 * plain
        for r, t, part in zip(sample, y, weight):
            at, x = [*r["buckets"], quality.BUCKETS], [*r["values"], 1.0]
            p = 1 / (1 + np.exp(-min(40, max(-40, float(plain[at] @ x)))))
            np.add.at(slope, at, (p - t) * part / sum(weight) * np.array(x))
        squares += slope**2
        plain -= 0.5 * slope / np.sqrt(squares)
    assert np.abs(plain - w).max() < 1e-6
    for r in quality.score(docs.limit(50)).collect():
        assert r["keep"] == (r["score"] >= quality.KEEP_AT)


def test_op5_counts_do_not_change_with_length():
    vote = lambda n, words=("one",): quality.votes(quality.Profile(" ".join(words[k % len(words)] for k in range(n)).encode()))[7]
    assert {vote(n) for n in (40, 499, 500, 501, 5000, 50_000)} == {1}
    many = [f"w{k}" for k in range(200)]
    assert {vote(n, many) for n in (400, 499, 500, 5000)} == {2}
    first, second = (quality.Profile(("x" * 9000 + end).encode()).buckets.tolist() for end in ("A1-", "A-1"))
    assert first != second  # shapes are read to the end of a word of any length
    a, b = (quality.Profile((f"{'x' * 5000}{c} " * 2).encode()) for c in "ab")
    assert a.repeats == b.repeats == 1 and quality.Profile(f"{'x' * 5000}a {'x' * 5000}b".encode()).repeats == 0


def test_op6_ids_and_offsets(spark, docs, odd):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    rng = random.Random(1)
    texts = [r["text"] for r in docs.collect()] + ["<|endoftext|> a", "a\u00a0b c", "tab\there", "it's  two", "\n\n", "x\n y", "don't\nstop 12,3", ""]
    texts += ["".join(rng.choice("ab 'sé\n\t1.,!\u00a0\u2028中ñ_-<|") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert list(np.frombuffer(pieces(t), "<u2")) == whole.encode(t, add_special_tokens=False).ids, repr(t)
    for table in (docs, odd):
        got = sorted(packing.pack(table).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        at = 0
        for r in got:
            assert r["sequence_id"] * packing.WINDOW + r["offset"] == at
            at += r["length"]
        ids = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in table.collect()}
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(ids[r["id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["id"]])
        assert at == sum(len(ids[r["doc_id"]]) for r in table.collect())
    assert packing.pack(odd.limit(0)).count() == 0


def test_op7_automaton_equals_globs(spark):
    rng = random.Random(2)
    globs = ["a*b", "^.ab/*", "*", "", "ab/a*a", "a^/b*", "*a/" + "b" * 70 + "*"]
    as_regex = [re.compile("".join(".*" if c == "*" else "[^/]*" if c == "^" else re.escape(c) for c in g), re.S) for g in globs]
    urls = ["".join(rng.choice("ab./") for _ in range(rng.randrange(12))) for _ in range(2000)] + ["xa/" + "b" * 90, "", "a" * 100_000 + "b"]
    got = urlrules.accepts(urlrules.build(globs), [u.encode() for u in urls])
    assert [[bool(x.fullmatch(u)) for x in as_regex] for u in urls] == got.tolist()
    pages = [(1, "HTTP://A.Example.COM/en/7?x"), (2, None), (3, "no scheme"), (4, "x://notcom/en/"), (5, "x://evil.org/a.com/en/1"), (6, "x://com/en/#y://z"), (7, "x://spam-farm.io/q")]
    rows = {r["id"]: r for r in urlrules.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert rows[1]["rule"] == "example.com/en/7" and rows[1]["verdict"] == "allow" and rows[1]["host"] == "a.example.com"
    assert rows[2]["host"] == rows[3]["path"] == "" and rows[2]["verdict"] == "allow" and rows[4]["rule"] is None and rows[5]["rule"] is None
    assert rows[6]["rule"] == "com/en/" and rows[6]["verdict"] == "block" and rows[7]["verdict"] == "block"
    odd = [(1, "x://com/en/a"), (1, "x://com/en/a"), (None, "x://com/en/a"), (2, ""), (3, "x://a.net/de/" + "b" * 500_000)]
    df = spark.createDataFrame([(*r, 7, "h", "p", "r", "v") for r in odd], "page_id long, url string, id int, host string, path string, rule string, verdict string")
    got = collections.Counter((r["id"], r["rule"], r["verdict"], len(r["path"])) for r in urlrules.judge(df).collect())
    assert got == {(1, "com/en/", "block", 5): 2, (None, "com/en/", "block", 5): 1, (2, None, "allow", 0): 1, (3, "net/de/", "allow", 500_004): 1}
    assert urlrules.judge(df.limit(0)).count() == 0


def test_op8_targets_and_copies(docs, odd):
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), F.col("id") == F.col("doc_id")).collect()
    assert len(got) == docs.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    sizes = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    goal, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:  # reshare what is above a cap
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    assert all(r["target"] == pytest.approx(goal[r["source"]]) for r in got)
    again = {(r["id"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert again == {(r["id"], r["taken"]) for r in got}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def test_op9_round_trip_and_damage(docs, odd):
    for table in (docs, odd):
        texts = collections.Counter((r["doc_id"], (r["text"] or "").encode()) for r in table.collect())
        got = mpeg.digests(mpeg.encode_audio(table)).collect()
        want = collections.Counter({(i, len(t), hashlib.sha256(mpeg.padded(t)).hexdigest()): n for (i, t), n in texts.items()})
        assert collections.Counter((r["id"], r["n_bytes"], r["payload_sha256"]) for r in got) == want
    data = mpeg.write_stream(mpeg.padded(bytes(range(256)) * 20))
    s = mpeg.parse_stream(data)
    assert s.samples == 1152 * len(s.offsets) == 1152 * s.table_frames and s.checked == len(s.offsets) + 1 and not s.bad and not s.lost
    broken = bytearray(data)
    broken[s.offsets[2]] = 0  # a header goes: the parser finds the next frame
    t = mpeg.parse_stream(bytes(broken))
    assert len(t.offsets) == len(s.offsets) - 1 and t.lost == 672
    broken = bytearray(data)
    broken[s.offsets[1] + 10] ^= 1  # side information: the checksum tells
    assert mpeg.parse_stream(bytes(broken)).bad == 1
    with pytest.raises(ValueError):
        mpeg.read_payload(bytes(broken), mpeg.parse_stream(bytes(broken)))
    assert mpeg.header_of(bytes([0xFF, 0xFB, 0x90, 0x00])).size == 417 and mpeg.parse_stream(b"").samples == 0
    assert mpeg.parse_audio(mpeg.encode_audio(docs)).count() == docs.count()


def test_op9_every_column(spark, docs, odd):
    for table in (docs, odd, odd.limit(0)):
        got = collections.Counter(map(tuple, mpeg.digests(mpeg.encode_audio(table)).collect()))
        want = collections.Counter()
        for r in table.collect():
            text = (r["text"] or "").encode()
            whole = text + b"\xff" * (-len(text) % 576 if text else 576)
            n = len(whole) // 576
            head = 10 + 10 + 8 + 12  # the tag's head, its one field's head, owner, length and checksum
            size, media = 672, mpeg.write_stream(whole)
            assert len(media) == head + (n + 1) * size and all(media[head + k * size + 23 : head + k * size + 599] == whole[(k - 1) * 576 : k * 576] for k in range(1, n + 1))
            s = mpeg.parse_stream(media)
            feature = f"frames={n};samples={1152 * n};rate=48000;ms={1152 * n * 1000 // 48000};kbps=224;table={n}/{(n + 1) * size}/right/{s.astray};tags=ID3v2.3+Xing;crc={n + 1}/{n + 1};lost=0"
            offsets = ",".join(str(head + k * size) for k in range(1, n + 1))
            row = (r["doc_id"], len(text), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, offsets)
            want[row] += 1
        assert got == want
    assert mpeg.parse_audio(spark.createDataFrame([(1, None), (1, None), (2, bytearray(b"no stream"))], "id long, media binary")).filter("frames = 0").count() == 3


def sealed(head, body):
    """A protected frame, filled up."""
    h = mpeg.header_of(head)
    bits = mpeg._layer2_bits(h, body) if h.layer == 2 else 4 * (32 if h.mono else 32 + h.bound) if h.layer == 1 else 8 * h.side
    register = 0xFFFF
    for k in range(16 + bits):  # bit by bit
        data = head[2:] + body
        bit = data[k // 8] >> (7 - k % 8) & 1
        register = ((register << 1) & 0xFFFF) ^ (0x8005 if bit ^ (register >> 15) else 0)
    return (head + register.to_bytes(2, "big") + body).ljust(h.size, b"\0")


def test_op9_layers_tags_and_tables():
    for head, body in ((bytes([0xFF, 0xFC, 0x44, 0xC0]), bytes([0x11, 0x22, 0x33] + [0] * 20)), (bytes([0xFF, 0xFE, 0x84, 0x40]), bytes(range(40))), (bytes([0xFF, 0xF4, 0x84, 0x00]), bytes([0xF0] * 40))):
        data = sealed(head, body) * 5
        s = mpeg.parse_stream(data)
        assert (len(s.offsets), s.checked, s.bad, s.lost) == (5, 5, 0, 0)
        broken = bytearray(data)
        broken[s.offsets[2] + 7] ^= 1
        assert mpeg.parse_stream(bytes(broken)).bad == 1
    free = bytes([0xFF, 0xFB, 0x04, 0xC0]) + b"\x01" * 296
    s = mpeg.parse_stream(b"junk" + free * 6)
    assert s.offsets == [4 + 300 * k for k in range(6)] and s.lost == 4
    data = mpeg.write_stream(mpeg.padded(bytes(range(256)) * 90))
    n = len(mpeg.parse_stream(data).offsets)
    item = (10).to_bytes(4, "little") + (1).to_bytes(4, "little")
    head, foot = (b"APETAGEX" + (2000).to_bytes(4, "little") + size.to_bytes(4, "little") + item[4:] + bytes([0, 0, 0, flag]) + bytes(8) for size, flag in ((10, 0xA0), (42, 0x80)))
    for text in (head + b"x" * 10 + data, data + head + b"x" * 10 + foot, data + head + b"x" * 10 + foot + b"TAG" + bytes(125)):
        s = mpeg.parse_stream(text)
        assert len(s.offsets) == n and s.lost == 0 and "APE" in s.tags and s.private
    old = b"ID3\x02\0\0" + bytes([0, 0, 0, 12]) + b"TT2\0\0\x03abc" + bytes(3)
    s = mpeg.parse_stream(old + data)
    assert s.fields == ["TT2", "PRIV"] and s.tags[:2] == ["ID3v2.2", "ID3v2.3"] and not s.lost
    body = b"PRIV" + (8).to_bytes(4, "big") + b"\0\0" + b"a\0\xff\0\xfb\xff\0\0z"
    s = mpeg.parse_stream(b"ID3\x03\0\x80" + bytes([0, 0, 0, len(body)]) + body + data[40:])
    assert s.private == {b"a": b"\xff\xfb\xff\0z"[:6]} and not s.lost  # unsynchronised: the zeros after 255 go
    one = bytes([0xFF, 0xFB, 0xC4, 0xC0])
    size = mpeg.header_of(one).size
    points = b"".join((2 * size).to_bytes(2, "big") for _ in range(4))
    table = (one + bytes(32) + b"VBRI" + bytes([0, 1, 0, 0, 0, 0]) + (9 * size).to_bytes(4, "big") + (8).to_bytes(4, "big") + bytes([0, 4, 0, 1, 0, 2, 0, 2]) + points).ljust(size, b"\0")
    s = mpeg.parse_stream(table + one.ljust(size, b"\0") * 8)
    assert s.seeks == [size * k for k in (1, 3, 5, 7)] and s.astray == 0 and not s.table_wrong and s.tags == ["VBRI"]
    assert mpeg.parse_stream(table + one.ljust(size, b"\0") * 7).table_wrong


def test_op10_removes_later_passages_only(spark, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    sentence = lambda: " ".join([word().capitalize(), *(word() for _ in range(9))]) + "."
    passage = " ".join(sentence() for _ in range(7))
    rows = [(k, " ".join([sentence() for _ in range(5)]) + (f" and {word()} {passage} then {word()} " if k in (3, 7, 9) else " ") + sentence()) for k in range(12)]
    got = {r["id"]: r for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in got if got[k]["n_removed"]} == {7, 9}
    for k in (7, 9):
        a, b = map(int, got[k]["removed_spans"].split(":"))
        assert rows[k][1][a:b] == passage and got[k]["text"] == rows[k][1][:a] + rows[k][1][b:]
    rows = {(r["id"], r["n_removed"]) for r in substrings.dedup_substrings(odd).collect()}
    assert rows == {(None, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0)}
    assert substrings.dedup_substrings(odd.limit(0)).count() == 0


def test_op10_removes_whole_passages_wherever_they_stand(spark):
    rng = random.Random(7)
    words = lambda n: [rng.choice("bcdfghjklm") + str(rng.randrange(10**6)) for _ in range(n)]
    wrapped = lambda ws: "".join(w + rng.choice((" ", " ", "\n", "  ")) for w in ws)
    rows, spans = [], {}
    for k, n in enumerate([30, 31, 51, 52, 55, 60, 66, 73, 80, 29]):
        passage = words(n)
        for copy, form in enumerate((str.lower, str.upper, str.capitalize)):
            before, after = words(40), words(40)
            text = [wrapped(before), wrapped(map(form, passage)).rstrip(), " " + wrapped(after)]
            rows.append((100 * copy + k, "".join(text)))
            if copy and n >= 30:
                spans[rows[-1][0]] = f"{len(text[0])}:{len(text[0]) + len(text[1])}"
    rows += [(500, " ".join(words(40))), (500, rows[0][1]), (None, rows[0][1])]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["removed_spans"] for r in got if r["n_removed"] and r["id"] != 500} == spans
    assert sorted(r["n_removed"] for r in got if r["id"] == 500) == [0, 1] and [r["n_removed"] for r in got if r["id"] is None] == [0]


def plain_removed(rows, line_words):
    """The words that stay of each (id, text), unit by unit."""
    held, out = collections.defaultdict(set), []
    units = []
    for i, text in rows:
        words, at, mine = text.lower().split(), 0, [(p, 30, (0, *text.lower().split()[p : p + 30])) for p in range(len(text.split()) - 29)]
        for line in text.split("\n"):
            n = len(line.split())
            if n >= line_words:
                mine.append((at, n, (1, *words[at : at + n])))
            at += n
        units.append(mine)
        for _, _, unit in mine:
            held[unit].add(i)
    for (i, text), mine in zip(rows, units):
        gone, lines = set(), set()
        for p, n, unit in sorted(mine, key=lambda u: u[:2]):
            if min(held[unit]) < i or (unit[0] and unit in lines):
                gone |= set(range(p, p + n))
            lines.add(unit)
        out.append((i, [w for p, w in enumerate(text.split()) if p not in gone]))
    return out


def test_op10_equals_plain_units(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["a", "b", "c"]) * rng.randrange(1, 3) + rng.choice("    \n") for _ in range(rng.randrange(200)))) for k in range(40)]
    rows += [(k + 40, rows[rng.randrange(40)][1][rng.randrange(20) :] + " tail") for k in range(40)]
    line = " ".join(f"v{k}" for k in range(20))
    rows += [(100 + k, f"head{k} x\n{line.upper() if k else line}\nother{k} y" + f"\n{line}" * k) for k in range(3)]
    rows += [(200, rows[0][1] + " z " + rows[1][1]), (200, rows[0][1] + " u " + line), (300, rows[5][1]), (301, rows[5][1].upper()), (301, rows[5][1].upper())]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, id int, part string, digest int")
    for line_words in (16, 5):
        want = plain_removed(rows, line_words)
        got = [(r["id"], r["text"].split()) for r in substrings.dedup_substrings(df, line_words=line_words).collect()]
        assert sorted(got) == sorted(want) and sum(len(w) for _, w in want) < sum(len(t.split()) for _, t in rows)


def test_scratch_removes_folders(spark, docs):
    from pathlib import Path

    from graphtrust import runtime

    with runtime.scratch(spark):
        substrings.dedup_substrings(docs).count()
        held = list(runtime._written)
        assert held and all(Path(p.removeprefix("file:")).exists() for p in held[-1:])
    assert not any(Path(p.removeprefix("file:")).exists() for p in held[-1:])


def test_very_long_texts(spark):
    """A text of two million characters, and one word of a million, through every operator."""
    long = " ".join(f"w{k % 5000} number {k}" for k in range(110_000)) + " mail me@mail.example.com or 10.1.2.3. All rights reserved"
    word = "x" * 1_000_000 + "1"
    rows = [(1, long, "a", 1, 7, 7), (2, word, "b", 1, 7, 7), (3, long, "a", 1, 7, 7), (4, "short one", None, 1, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, id int, row int").cache()
    of = lambda df: {r["id"]: r for r in df.collect()}
    classes = of(simhash.near_duplicate_classes(docs))
    assert {i: r["component_id"] for i, r in classes.items()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert classes[1]["fp"] == simhash.fingerprint(np.unique(simhash.shingle_hashes(long.encode(), 5)), 4).hex()
    found = of(pii.detect(docs, field=pii.fit_field([])))
    assert [(r["n_email"], r["n_ip"]) for r in (found[1], found[2])] == [(1, 1), (0, 0)]
    labels = of(licences.license_labels(docs))
    assert labels[1]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", long)) and labels[1]["base_labels"] == "reserved" and labels[2]["n_words"] == 1
    assert set(of(quality.score(docs))) == {1, 2, 3, 4}
    pieces = [r for r in packing.pack(docs).collect() if r["id"] == 1]
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] > 300_000
    sizes = of(mixing.mix(docs))
    assert sizes[1]["size"] == len(long.split()) and sizes[2]["size"] == 1
    media = of(mpeg.digests(mpeg.encode_audio(docs)))
    assert media[1]["payload_sha256"] == media[3]["payload_sha256"] == hashlib.sha256(mpeg.padded(long.encode())).hexdigest()
    kept = of(substrings.dedup_substrings(docs))
    assert kept[1]["text"] == long and kept[2]["text"] == word and kept[3]["text"] == "" and kept[4]["text"] == "short one"


def clashing(spark, rows):
    """Documents with columns of the names that operators use themselves."""
    names = ("id", "size", "copies", "copy", "row", "kept", "fp", "target", "source_size", "taken")
    return spark.createDataFrame([(*r, *[777] * len(names)) for r in rows], "doc_id long, text string, source string, n_chars int, " + ", ".join(f"{c} int" for c in names))


def test_pipeline_stages_on_odd_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(n)) + "."
    one, two = text(80), text(60)
    rows = [(1, one, "a", len(one)), (1, one, "a", len(one)), (None, one, "b", len(one)), (2, two, None, len(two)), (None, two + " x", "b", 1), (7, None, "b", None), (8, "", None, 0), (None, None, "a", None), (9, text(30_000), "a", 1)]
    rows += [(20 + k, text(50), "ab"[k % 2], 1) for k in range(20)]
    docs = clashing(spark, rows)
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mask_personal_data, corpus_pipeline.mix_sources):
        got, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert got.columns == none.columns == docs.columns and none.count() == 0
        assert got.filter("id = 777 and size = 777 and copies = 777 and copy = 777 and row = 777 and kept = 777").count() == got.count() > 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 7, 9, *range(20, 40)]  # one row a class: repeated rows, copies without ids, empty texts
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +want
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in packed.filter("start = 0").collect()) == sorted(r[0] or 0 for r in rows)
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SF).count() == 0


def test_pipeline_runs_and_catches_near_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sorted(got.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in rows:
        assert r["sequence_id"] * 2048 + r["offset"] == at and r["doc_id"] in ids
        at += r["length"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shingles = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        shingles[r["doc_id"]] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    near = {}  # the least earlier document that shares most of its shingles
    for i, a in sorted(shingles.items()):
        near[i] = [j for j, b in shingles.items() if j < i and len(a & b) >= 0.8 * len(a | b)]
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert all(i not in left for i, found in near.items() if found)  # no pair of 0.8 or more stays
    alone = {i for i, a in shingles.items() if all(len(a & b) < 0.3 * len(a | b) for j, b in shingles.items() if j != i)}
    assert alone <= left  # nothing without a near copy goes


def test_pipeline_stages(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    held = docs.collect()
    good = {r["id"] for r in quality.score(docs).filter("keep").collect()}
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == good and kept.columns == docs.columns
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    first = {}
    for r in sorted(held, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    left = {r["doc_id"] for r in single.collect()}
    assert left <= set(first.values()) and single.columns == docs.columns
    masked = corpus_pipeline.mask_personal_data(spark, docs, SF)
    assert masked.schema.names == docs.schema.names and all(not pii.base_spans(r["text"]) for r in masked.collect())
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    copies = {r["id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({k: v for k, v in copies.items() if v})
