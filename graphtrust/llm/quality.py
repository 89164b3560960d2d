"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

One pass over the texts writes each document's votes and hashed shape features. The vote patterns (at most 3 **
labellers of them) are counted in Spark; expectation-maximisation over all of them estimates each labeller's confusion and
the share of good documents. A logistic scorer is trained on the posteriors of a bounded sample (SAMPLE_DOCS) and
scores every document. The labels table is used for held-out accuracy only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtrust.llm.common import id_text, map_rows, powers, small_batches
from graphtrust.runtime import spill

#: Documents of the training sample at most; hashed features; rounds of either fit; score from which a document is kept.
SAMPLE_DOCS, BUCKETS, EM_ROUNDS, FIT_ROUNDS, KEEP_AT = 4000, 1 << 14, 60, 80, 0.5
#: Labellers; words of the windows, side by side over the whole text, in which distinct words are counted.
LABELLERS, SPAN = 10, 256


def _kinds() -> np.ndarray:
    """The kind of each byte: 0 white space, 1 lower, 2 upper, 3 digit, 4 starts another letter, 5 goes on with one, else itself."""
    kinds = np.arange(256, dtype=np.uint8)
    for k, span in ((0, (*range(9, 14), 32)), (1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, range(192, 256)), (5, range(128, 192))):
        kinds[list(span)] = k
    kinds[[k for k in range(32) if kinds[k]]] = 6
    return kinds


_KIND = _kinds()
_IS_ODD = np.isin(np.arange(256), np.frombuffer(b"!$*%#&|@<>{}[]\\^~=_", np.uint8))


class Profile:
    """Counts that labellers and features share, over the whole text (UTF-8), in numpy."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        kind = _KIND[raw]
        solid = np.flatnonzero(kind)
        self.n = self.fresh = self.pairs = self.repeats = 0
        self.chars = self.letters = self.capitals = self.upper = self.symbols = self.odd = self.tails = self.bars = 0
        self.buckets = np.zeros(0, np.int64)
        if not len(solid):
            return
        raw, kind = raw[solid], kind[solid]
        begins = np.concatenate([[True], np.diff(solid) > 1])
        first = np.flatnonzero(begins)
        self.n = len(first)
        word = np.cumsum(begins) - 1
        size = np.diff(np.concatenate([first, [len(raw)]]))
        place = np.arange(len(raw)) - first[word]
        counted = lambda mask: np.bincount(word[mask], minlength=self.n)
        upper, symbol = counted(kind == 2), counted(_IS_ODD[raw])
        self.chars, self.capitals, self.symbols = len(raw) - np.count_nonzero(kind == 5), int(upper.sum()), int(symbol.sum())
        self.letters = self.capitals + np.count_nonzero(kind == 1) + np.count_nonzero(kind == 4)
        if self.capitals:
            self.upper = int(((upper > 1) & (counted(kind == 1) == 0)).sum())
        self.odd = np.count_nonzero(symbol)
        last = first + size - 1
        last -= (size > 2) & ((raw[last] == 44) | (raw[last] == 46))  # a comma or stop may follow
        self.tails = int(((size > 1) & (raw[last] == raw[last - 1]) & (kind[last] > 6)).sum())
        self.bars = int(((size == 1) & (raw[first] == 124)).sum())
        names = np.add.reduceat(raw.astype(np.uint64) * powers(int(size.max()))[place], first)
        spans = (np.arange(self.n) // SPAN).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.fresh = len(set((names + spans).tolist()))  # distinct words of each window, summed, so that texts of any length compare
        self.repeats = int((names[1:] == names[:-1]).sum())
        self.pairs = len(set((names[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + names[:-1]).tolist()))
        # shapes: runs of one kind shortened to two, then hashed
        kept = kind != 5
        kind, word, begins = kind[kept], word[kept], begins[kept]
        same = np.concatenate([[False], (kind[1:] == kind[:-1]) & (word[1:] == word[:-1])])
        kept = ~(same & np.concatenate([[False], same[:-1]]))
        kind, word = kind[kept], word[kept]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        place = np.arange(len(word)) - np.repeat(first, np.diff(np.concatenate([first, [len(word)]])))
        shapes = np.add.reduceat((kind.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place], first)
        self.buckets = ((shapes >> np.uint64(20)) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64


def votes(p: Profile) -> list[int]:
    """A vote of each labeller: 2 good, 1 bad, 0 abstains (as on texts too short for it)."""

    def share(x: float, of: float, good: float, bad: float, least: int = 1) -> int:
        return 0 if p.n < least or not of else 2 if x <= good * of else 1 if x >= bad * of else 0

    if not p.n:
        return [1] * LABELLERS
    return [
        share(p.odd, p.n, 0.08, 0.2),
        share(p.symbols, p.chars, 0.02, 0.06),
        share(p.tails, p.n, 0.05, 0.2),
        share(p.upper, p.n, 0.1, 0.3, 5),
        share(p.capitals, p.letters, 0.2, 0.35, 5),
        share(p.repeats, p.n, 0.08, 0.2, 8),
        share(p.n - 1 - p.pairs, p.n, 0.3, 0.5, 20),
        share(p.n - p.fresh, p.n, 0.8, 0.92, 40),
        share(p.bars, p.n, 0.01, 0.08, 8),
        share(p.chars - p.letters, p.chars, 0.15, 0.45),
    ]


def pattern(vote: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(vote))


def weak_labels(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of good for each pattern, confusion[class, labeller, vote]) by expectation-maximisation over pattern counts.

    It starts from the majority being good, where no labeller that votes says bad.
    """
    if not counts:
        return {}, np.zeros((2, LABELLERS, 3))
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    vote = np.array([[c // 3**k % 3 for k in range(LABELLERS)] for c in codes])
    onehot = np.eye(3)[vote]
    good = np.where((vote == 1).any(axis=1), 0.1, 0.95)
    for _ in range(EM_ROUNDS):
        weights = np.stack([(1 - good) * n, good * n])
        prior = (weights.sum(axis=1) + 1) / (n.sum() + 2)
        seen = np.einsum("cp,plv->clv", weights, onehot)
        seen[:, :, 0] = 0  # an abstention says nothing
        confusion = (seen + [0, 0.5, 0.5]) / (seen.sum(axis=2, keepdims=True) + 1)
        confusion[:, :, 0] = 1
        log = np.log(prior) + np.einsum("plv,clv->pc", onehot, np.log(confusion))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        good = p[:, 1] / p.sum(axis=1)
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), confusion


def features(p: Profile) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values), of unit length: shares of word shapes, hashed, and twentieths of some shares as indicators in the first buckets."""
    counts = np.bincount(p.buckets, minlength=1)
    shapes = np.flatnonzero(counts)
    counts = counts[shapes]
    marks = [11 * k + min(10, int(20 * x / max(1, p.n))) for k, x in enumerate((p.odd, p.upper, p.repeats, p.bars, p.tails))]
    marks += [55 + min(4, int(5 * p.fresh / max(1, p.n))), 60 + (p.n == 0)]
    values = np.concatenate([np.ones(len(marks)), np.sqrt(counts / max(1, p.n))])
    return np.concatenate([marks, shapes]).astype(np.int64), values / np.sqrt((values**2).sum())


def fit_scorer(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights (the last: bias) of a logistic scorer on posteriors, by Adagrad; the rarer class is weighted up."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(r[0]) + 1 for r in rows])
    col = np.concatenate([np.array([*r[0], BUCKETS]) for r in rows]).astype(int)
    val = np.concatenate([np.array([*r[1], 1.0]) for r in rows])
    y = np.array([r[2] for r in rows])
    weight = y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)
    weight /= weight.sum()
    squares = np.full_like(w, 1e-8)
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(rows)), -40, 40)))
        slope = np.bincount(col, val * ((p - y) * weight)[row], BUCKETS + 1) + 1e-6 * w
        squares += slope**2
        w -= 0.5 * slope / np.sqrt(squares)
    return w


_PROFILE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("pattern", T.IntegerType()), T.StructField("bad", T.IntegerType()), T.StructField("draw", T.LongType()),
    T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
])


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, bad, draw, buckets, values) of each row, written: votes, a hash to draw samples by, and features."""

    def fn(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            p = Profile(t)
            v, (buckets, values) = votes(p), features(p)
            yield i, pattern(v), v.count(1), xxhash.xxh3_64_intdigest(t) >> 1, buckets.tolist(), values.tolist()

    return spill(map_rows(id_text(docs, id_col, text_col), fn, _PROFILE, as_bytes=True), "profiles")


def train(profiled: DataFrame) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of each vote pattern over all documents, scorer weights)."""
    counts = {r["pattern"]: r["count"] for r in profiled.groupBy("pattern").count().collect()}  # at most 3 ** LABELLERS
    good, _ = weak_labels(counts)
    last = profiled.select("draw").orderBy("draw").limit(SAMPLE_DOCS).agg(F.max("draw")).first()[0]
    drawn = profiled.filter(F.col("draw") <= F.lit(last))  # few rows but for ties, so features of the rest are not moved
    sample = drawn.orderBy("draw", "id").limit(SAMPLE_DOCS).select("pattern", "buckets", "values").collect()
    return good, fit_scorer([(r["buckets"], r["values"], good[r["pattern"]]) for r in sample])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bad_votes, posterior, score, keep) of each row: the weak label's and the scorer's probability of good.

    A null text is empty, and an empty text is bad by vote; a very long one is counted whole, its distinct words in windows.
    Repeated rows score alike, null ids like any. Ties: a score of KEEP_AT is kept; sampled documents of equal hash go by
    id. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    profiled = profiles(docs, id_col, text_col)
    good, w = train(profiled)
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n_bad_votes", T.IntegerType()),
        T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType()),
    ])

    def fn(ids, patterns, bad, buckets, values):
        for i, code, n, b, v in zip(ids, patterns, bad, buckets, values, strict=True):
            s = _logistic(w, np.array(b, int), np.array(v))
            yield i, n, good[code], s, s >= KEEP_AT

    return map_rows(profiled.select("id", "pattern", "bad", "buckets", "values"), fn, schema)


def _logistic(w: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> float:
    total = float(w[BUCKETS] + w[buckets] @ values)
    return float(1 / (1 + np.exp(-max(-40.0, min(40.0, total)))))


def keep_good(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, whose score is KEEP_AT or more, else as score(). Texts are read once to train and once to filter; nothing is shuffled."""
    _, w = train(profiles(docs, id_col, text_col))
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.columns[names.index(text_col)].to_pylist()
            yield batch.filter(pa.array([_logistic(w, *features(Profile((t or "").encode()))) >= KEEP_AT for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
