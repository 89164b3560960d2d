"""Personal data: exact patterns, and a skip-chain conditional random field that adds spans.

The field's variables are a text's candidate tokens, those with a digit or an at sign (every other token has the
label "none" for sure). Chain potentials link neighbouring candidates, skip potentials link each candidate with
the previous one in the text that repeats it or is similar (the same shape of at least six digits, or the same
trailing digits). Loopy message passing gives marginals: the chain is solved exactly, given the skip links' messages,
and those are passed anew, in turn. A span is added where a label's marginal reaches
ADD_AT and no pattern's span overlaps. The weights are fitted by pseudo-likelihood on a bounded sample of
documents (SAMPLE_DOCS), labelled by the patterns; features see shapes and neighbours, never the patterns' verdict.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtrust.llm.common import id_text, map_rows

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Documents and candidate tokens of the training sample at most; hashed features; the marginal from which a span is added.
SAMPLE_DOCS, SAMPLE_TOKENS, BUCKETS, ADD_AT = 3000, 60_000, 2048, 0.9
#: Rounds of skip messages at most, and the change of a message below which they have settled.
ROUNDS, SETTLED = 30, 1e-3
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else _DOUBLED[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain. The local part is the whole run before the sign, so each sign is looked at once."""
    spans, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        stop = None
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            stop = m.end()
            spans.append((start, stop))
        last = stop or at + 1
        at = text.find("@", last)
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns, ordered by start and then kind. Each takes time linear in the text."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Tokens:
    """The candidate tokens of a text: spans, feature buckets, and the skip partner of each (itself: none)."""

    spans: list
    features: list
    partner: list


def _shape(token: str) -> str:
    """The kinds of all characters, runs of one kind shortened to two."""
    out: list[str] = []
    for c in token:
        s = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if len(out) < 2 or out[-1] != s or out[-2] != s:
            out.append(s)
    return "".join(out)


def _word_before(text: str, at: int) -> str:
    """The whole word before a place; each is looked at for one candidate only, so all of them cost the text's length."""
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at]


def candidates(text: str) -> Tokens:
    spans, features, partner = [], [], []
    seen: dict[str, int] = {}
    for m in _TOKEN.finditer(text):
        a, b, token = m.start(), m.end(), m[0]
        digits = "".join(filter(str.isdigit, token))
        shape, before = _shape(token), _word_before(text, a)
        words = {
            "shape " + shape, f"digits {min(len(digits), 24)}", f"length {min(len(token), 40)}", f"dots {min(token.count('.'), 5)}",
            f"at {min(token.count('@'), 2)}", "first " + shape[:3], "last " + shape[-3:],
            "before " + (_shape(before) if before and text[a - 1] != "\n" else "-"), "plus " + str(token.startswith("+")),
        }
        features.append(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words}))
        n = len(spans)
        keys = [f"= {token.strip('.,;:!?()[]').lower()}"] + ([f"# {digits[-7:]}"] if len(digits) >= 7 else []) + ([f"~ {shape} {len(digits)}"] if len(digits) >= 6 else [])
        partner.append(next((seen[k] for k in keys if k in seen), n))
        seen.update(dict.fromkeys(keys, n))
        spans.append((a, b))
    return Tokens(spans, features, partner)


def _labels(spans: list, base: list) -> list[int]:
    """0 for none, or 1 + the kind of the first pattern span that overlaps each token."""
    out, k = [], 0
    for a, b in spans:
        while k < len(base) and base[k][1] <= a:
            k += 1
        out.append(1 + KINDS.index(base[k][2]) if k < len(base) and base[k][0] < b else 0)
    return out


@dataclass
class Field:
    """Weights: local (BUCKETS + 1 bias rows), chain and skip potentials, each by labels."""

    local: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit_field(tokens: list[tuple[list[int], int, int, int, int]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each token's label given its neighbours'. tokens: (features, label, labels before, after and of the partner; -1: none)."""
    n_labels = len(KINDS) + 1
    local, chain, skip = np.zeros((BUCKETS + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros((n_labels, n_labels))
    if not tokens:
        return Field(local, chain, skip)
    row = np.repeat(np.arange(len(tokens)), [len(t[0]) + 1 for t in tokens])
    col = np.concatenate([np.array([*t[0], BUCKETS]) for t in tokens])
    y, before, after, pair = (np.array([t[k] for t in tokens]) for k in (1, 2, 3, 4))
    target = np.eye(n_labels)[y]
    squares = [np.full_like(w, 1e-6) for w in (local, chain, skip)]
    for _ in range(rounds):
        score = np.zeros((len(tokens), n_labels))
        np.add.at(score, row, local[col])
        for side, w in ((before, chain), (after, chain.T), (pair, skip)):
            score[side >= 0] += w[side[side >= 0]]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = p / p.sum(axis=1, keepdims=True) - target
        slopes = [np.zeros_like(w) for w in (local, chain, skip)]
        np.add.at(slopes[0], col, error[row])
        np.add.at(slopes[1], before[before >= 0], error[before >= 0])
        back = np.zeros_like(chain)
        np.add.at(back, after[after >= 0], error[after >= 0])
        slopes[1] += back.T
        np.add.at(slopes[2], pair[pair >= 0], error[pair >= 0])
        slopes[2] = (slopes[2] + slopes[2].T) / 2
        for w, g, s in zip((local, chain, skip), slopes, squares, strict=True):
            g = g / len(tokens) + decay * w
            s += g * g
            w -= rate * g / np.sqrt(s)
    return Field(local, chain, skip)


def _products(tables: np.ndarray) -> np.ndarray:
    """The products of all tables up to each, in order, each scaled; by doubling, so in log2(n) steps."""
    out, step = tables.copy(), 1
    while step < len(out):
        out[step:] = out[:-step] @ out[step:]
        out[step:] /= out[step:].max(axis=(1, 2), keepdims=True)
        step *= 2
    return out


def _chain(unary: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exact marginals of a chain, from potentials of its nodes (log) and of neighbours."""
    local = np.exp(unary - unary.max(axis=1, keepdims=True))
    steps = np.exp(table - table.max()) * local[1:, None, :]
    ahead = np.concatenate([local[:1], local[0] @ _products(steps)]) if len(steps) else local
    behind = np.ones_like(local)
    if len(steps):
        behind[:-1] = _products(steps[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1).sum(axis=2)
    held = ahead * behind
    return held / held.sum(axis=1, keepdims=True)


def marginals(tokens: Tokens, field: Field) -> np.ndarray:
    """Label marginals of each token by loopy message passing; exact where no token has a skip partner.

    In a round the chain is solved whole, by forward and backward products, and then each skip link passes a message
    either way: its sender's marginals without what it was sent, through the link's potentials, damped by half.
    """
    n = len(tokens.spans)
    unary = np.array([field.local[f].sum(axis=0) for f in tokens.features]) + field.local[BUCKETS]
    partner = np.array(tokens.partner)
    later = np.flatnonzero(partner != np.arange(n))
    if not len(later):
        return _chain(unary, field.chain)
    src, dst = np.concatenate([partner[later], later]), np.concatenate([later, partner[later]])
    back = np.roll(np.arange(len(src)), len(later))
    table = np.exp(field.skip - field.skip.max())
    tables = np.concatenate([np.repeat(table[None], len(later), axis=0), np.repeat(table.T[None], len(later), axis=0)])
    sent = np.zeros((len(src), unary.shape[1]))
    for k in range(ROUNDS + 1):
        held = unary.copy()
        np.add.at(held, dst, sent)
        p = _chain(held, field.chain)
        if k == ROUNDS:
            break
        inner = np.log(np.maximum(p[src], 1e-300)) - sent[back]
        inner = np.exp(inner - inner.max(axis=1, keepdims=True))
        new = np.log(np.maximum((inner[:, None, :] @ tables)[:, 0], 1e-300))
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - sent).max()
        sent = (sent + new) / 2
        if change < SETTLED:
            break
    return p


def find_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    tokens = candidates(text)
    if not tokens.spans:
        return base, base
    p = marginals(tokens, field)
    taken, added = _labels(tokens.spans, base), []
    for (a, b), label, q in zip(tokens.spans, taken, p, strict=True):
        best = int(q.argmax())
        if best and not label and q[best] >= ADD_AT:
            token = text[a:b]
            core = token.strip(".,;:!?()[]{}<>\"'*$%#&")
            if core:
                added.append((a + token.index(core), a + token.index(core) + len(core), KINDS[best - 1]))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on the candidates of SAMPLE_DOCS documents (least hashes of id and text length) and at most SAMPLE_TOKENS tokens.

    Only hashes are ranked; the texts below the last hash drawn stay where they are read. Repeated rows tie, and all of a tie are taken.
    """
    rows = id_text(docs, id_col, text_col).filter(F.col("txt").rlike("[0-9@]"))
    rank = F.xxhash64("id", F.length("txt"))
    cut = rows.select(rank.alias("rank")).orderBy("rank").limit(SAMPLE_DOCS).agg(F.max("rank")).first()[0]
    sample = rows.filter(rank <= F.lit(cut))
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType())),
        *(T.StructField(c, T.IntegerType()) for c in ("y", "before", "after", "pair")),
    ])

    def fn(ids, texts):
        for i, text in zip(ids, texts, strict=True):
            t = candidates(text)
            y = _labels(t.spans, base_spans(text))
            for n, f in enumerate(t.features):
                yield i, n, f, y[n], y[n - 1] if n else -1, y[n + 1] if n + 1 < len(y) else -1, y[t.partner[n]] if t.partner[n] != n else -1

    got = map_rows(sample, fn, schema).orderBy(F.xxhash64("id", "n"), "id", "n").limit(SAMPLE_TOKENS).collect()
    return fit_field([(r["f"], r["y"], r["before"], r["after"], r["pair"]) for r in got])


def _listed(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row; counts are of the patterns' spans.

    Null texts are empty and have no spans; repeated rows have each their result; null ids are kept. A very long text is
    searched whole: patterns cost its length, the field its candidates times the logarithm of their number. Ties: of spans
    with one start the kind listed first comes first, of equal labels the first. Other columns are ignored, whatever
    their names; an empty table gives no rows. Spans are in code points, the end exclusive.
    """
    field = field or train(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    ])

    def fn(ids, texts):
        for i, text in zip(ids, texts, strict=True):
            base, spans = find_spans(text, field)
            yield i, *(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)

    return map_rows(id_text(docs, id_col, text_col), fn, schema)


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", field: Field | None = None) -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets; all other columns stay. A null text stays null."""
    field = field or train(docs, id_col, text_col)

    def replaced(text: str) -> str:
        out, at = [], 0
        for a, b, kind in find_spans(text, field)[1]:
            if b > at:
                out += [text[at : max(a, at)], f"<{kind}>" if a >= at else ""]
                at = b
        return "".join([*out, text[at:]])

    return replace_text(docs, text_col, replaced)


def replace_text(docs: DataFrame, text_col: str, fn) -> DataFrame:
    """docs with text_col mapped through fn in Arrow batches; nulls stay."""
    import pyarrow as pa

    from graphtrust.llm.common import small_batches

    names = docs.columns

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            at = names.index(text_col)
            columns[at] = pa.array([None if t is None else fn(t) for t in columns[at].to_pylist()], type=columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(run, docs.schema)
