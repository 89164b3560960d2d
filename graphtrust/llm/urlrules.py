"""URL filters: a bit-parallel wildcard automaton.

All glob rules are packed into Shift-And masks of as many 64-bit words as they need; one pass over the bytes
of a canonical URL (lower-cased host and path) simulates every pattern at once, and all URLs of a batch step together
in numpy. In a glob, `*` stands for any bytes, and `^` for any bytes but `/`, so that a host's wildcard ends with the host.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtrust.llm.common import map_rows, small_batches

_ONE = np.uint64(1)


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text from after the first :// up to / ? # or the end; empty where there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def path_of(url: Column) -> Column:
    """Text after the host up to ? # or the end; empty where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Automaton:
    """steps[c]: bits whose byte is c; stays[c]: bits before which a wildcard takes c; first: bits active at the start; ends: each pattern's last bit."""

    steps: np.ndarray
    stays: np.ndarray
    first: np.ndarray
    ends: list[int]
    open_ended: list[bool]


def build(globs: Sequence[str]) -> Automaton:
    """A bit for each literal byte of each glob and one for its start, so an empty prefix is a state of its own."""
    plan: list[tuple[int | None, str]] = []  # (byte or None for a start bit, wildcard that stands after it)
    starts, ends, open_ended = [], [], []
    for glob in globs:
        starts.append(len(plan))
        plan.append((None, ""))
        for c in glob:
            if c in "*^":
                plan[-1] = (plan[-1][0], c if plan[-1][1] != "*" else "*")
            else:
                plan += [(b, "") for b in c.encode()]
        ends.append(len(plan) - 1)
        open_ended.append(plan[-1][1] == "*")
    words = max(1, -(-len(plan) // 64))
    steps, stays, first = (np.zeros(s, np.uint64) for s in ((256, words), (256, words), words))
    for k, (byte, wild) in enumerate(plan):
        bit = _ONE << np.uint64(k % 64)
        if byte is not None:
            steps[byte, k // 64] |= bit
        if wild:
            taken = np.ones(256, bool)
            taken[ord("/")] = wild == "*"
            stays[taken, k // 64] |= bit
    for k in starts:
        first[k // 64] |= _ONE << np.uint64(k % 64)
    return Automaton(steps, stays, first, ends, open_ended)


def accepts(auto: Automaton, urls: Sequence[bytes]) -> np.ndarray:
    """(url, pattern) booleans: whether the whole URL matches. Longer URLs are stepped on alone, so each costs its own length."""
    out = np.zeros((len(urls), len(auto.ends)), bool)
    if not len(urls):
        return out
    lengths = np.array([len(u) for u in urls])
    order = np.argsort(lengths, kind="stable")
    flat, offset = np.frombuffer(b"".join(urls), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    state = np.tile(auto.first, (len(urls), 1))
    live = order
    for at in range(int(lengths.max()) + 1):
        done = np.searchsorted(lengths[live], at, side="right")
        live = live[done:]
        if not len(live):
            break
        byte = flat[offset[live] + at]
        now = state[live]
        moved = now << _ONE
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[live] = (moved & auto.steps[byte]) | (now & auto.stays[byte])
    for p, end in enumerate(auto.ends):
        out[:, p] = (state[:, end // 64] >> np.uint64(end % 64)) & _ONE != 0
    return out


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and all its subdomains, for paths that start with `path` (after the first slash)."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"

    def globs(self) -> list[str]:
        return [f"{self.name}*", f"^.{self.name}*"]


#: The rules of the query.
RULES = (
    Rule("com", "en/", "block"), Rule("example.com", "en/7", "allow"), Rule("net", "de/", "allow"), Rule("example.net", "de/8", "block"), Rule("org", "es/", "block"),
)
#: The method's own globs, for URLs that no rule fits: block where any matches, else allow.
BLOCKED_GLOBS = ("^spam^/*", "^pills^/*", "^casino^/*", "*/ads/*", "*/tracking/*")


def judge(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS) -> DataFrame:
    """(id, host, path, rule, verdict) of each row. The rule that fits with the longest name wins (ties: the first given).

    A null URL, or one without ://, has an empty host and path, fits no rule and is allowed unless a glob matches the
    empty text. Repeated rows and null ids are judged each. A very long URL is stepped through whole, alone after the
    others of its batch have ended. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    auto = build([g for r in ranked for g in r.globs()] + list(blocked))
    url = F.col(url_col)
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def fn(ids, hosts, paths):
        got = accepts(auto, [h + p for h, p in zip(hosts, paths, strict=True)])
        fits = got[:, : 2 * len(ranked)].reshape(len(got), len(ranked), 2).any(axis=2)
        bad = got[:, 2 * len(ranked) :].any(axis=1)
        for i, h, p, fit, block in zip(ids, hosts, paths, fits, bad, strict=True):
            rule = ranked[int(fit.argmax())] if fit.any() else None
            yield i, h.decode(), p.decode(), rule and rule.name, rule.verdict if rule else "block" if block else "allow"

    return map_rows(rows, fn, schema, as_bytes=True)
