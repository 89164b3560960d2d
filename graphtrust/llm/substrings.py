"""Substring dedup by hashed units: whole lines, and runs of words wherever they begin and end.

A unit is a line of LINE_WORDS words or more, or a gram: LEAST_WORDS words in a row. Units are normalised (lower case,
single spaces) and their digests grouped over all documents; the occurrence in the smallest id is kept, and of the lines of
one document the first. The others' unions are the removed spans, with their offsets in the original text. Copies of a
whole text are told by one digest, so that their units are hashed once. To keep the grouped grams few, each is first stood
for by its anchor, the least hash of the WINDOW_WORDS words in a row inside it: equal grams have equal anchors, a text has
about one in twelve words, and only grams whose anchor some other text shares are hashed and grouped themselves.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtrust.llm.common import id_text, join_often, likely, map_rows
from graphtrust.runtime import drop_folder, spill

#: Words that an anchor hashes; words of a gram, and so of a removed span inside lines at least; words of a line that counts as a unit.
WINDOW_WORDS, LEAST_WORDS, LINE_WORDS = 8, 30, 16
_WORD = re.compile(r"\S+")
_FACTOR = 0x9E3779B97F4A7C15
_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
_KEY = [T.StructField("id", T.LongType()), T.StructField("part", T.LongType())]
_UNITS = T.StructType([*_KEY, T.StructField("whole", T.BinaryType()), T.StructField("anchors", _LONGS), T.StructField("lines", _LONGS), *(T.StructField(c, _INTS) for c in ("firsts", "sizes", "own_firsts", "own_sizes"))])
_GRAMS = T.StructType([*_KEY, T.StructField("digests", _LONGS), T.StructField("firsts", _INTS)])


def normal_words(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    found = _WORD.findall(text)
    words = text.lower().split()
    return words if len(words) == len(found) else [w.lower() for w in found]  # else a lower-cased character splits


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n in a row, put together from runs of powers of two."""
    out, at, run, size, last = None, n, hashes, 1, len(hashes) - n + 1
    while size <= n:
        if n & size:  # the runs of lesser powers stand to the right
            at -= size
            part = run[at : at + last] * np.uint64(pow(_FACTOR, n - at - size, 2**64))
            out = part if out is None else out + part
        run = run[:-size] * np.uint64(pow(_FACTOR, size, 2**64)) + run[size:]
        size *= 2
    return out


def anchored(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, anchor) of the gram at each word; empty where the text is shorter than one."""
    if len(hashes) < LEAST_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least, width, size = rolled(hashes, WINDOW_WORDS), LEAST_WORDS - WINDOW_WORDS + 1, 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return rolled(hashes, LEAST_WORDS).view(np.int64), least.view(np.int64)


def line_units(text: str, words: list[str], least: int) -> list[tuple[int, int, int]]:
    """(digest, first word, words) of each line of at least `least` words, of the text's normalised words."""
    found, at = [], 0
    for line in text.split("\n"):
        n = len(line.split())
        if n >= least:
            unit = " ".join(words[at : at + n]).encode("utf-8", "surrogatepass")
            found.append((xxhash.xxh3_64_intdigest(unit, 1) - (1 << 63), at, n))
        at += n
    return found


def removed(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the unions of overlapping or adjacent units (first word, words).

    A single word that a sentence end parts from the rest of a union longer than a gram, with text beyond it on its line,
    is taken for its neighbours' and stays: there a word may well be equal by chance.
    """
    if not units:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for first, n in sorted(units):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], first + n)
        else:
            runs.append([first, first + n])
    stops = lambda k: text[words[k][1] - 1] in ".!?"
    same_line = lambda a, b: "\n" not in text[words[a][1] : words[b][0]]
    for run in runs:
        if run[1] < len(words) and run[1] - run[0] > LEAST_WORDS and same_line(run[1] - 1, run[1]) and stops(run[1] - 2) and not stops(run[1] - 1):
            run[1] -= 1
        if run[0] and run[1] - run[0] > LEAST_WORDS and same_line(run[0] - 1, run[0]) and stops(run[0]) and not stops(run[0] - 1):
            run[0] += 1
    return [(words[a][0], words[b - 1][1]) for a, b in runs]


def _part(text_col: str) -> Column:
    """A hash of the text, as rows of one id may differ."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("part")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """(id, part, copy, units), written: for the texts that have something to remove, whether the whole text stood before and which units (first, n) did."""
    texts = id_text(docs, id_col, text_col, _part(text_col)).filter("id is not null")

    def units(ids, texts, parts):
        for i, text, part in zip(ids, texts, parts, strict=True):
            words = normal_words(text)
            if len(words) < min(LEAST_WORDS, line_words):
                continue
            _, anchors = anchored(word_hashes(words)) if len(words) >= LEAST_WORDS else (None, ())
            seen, kept, own = set(), [], []
            for unit in line_units(text, words, line_words):
                (own if unit[0] in seen else kept).append(unit)
                seen.add(unit[0])
            if len(anchors) or kept:
                whole = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                yield i, part, whole, np.unique(anchors), *([u[k] for u in kept] for k in (0, 1, 2)), *([u[k] for u in own] for k in (1, 2))

    def grams(ids, texts, parts, shared):
        for i, text, part, held in zip(ids, texts, parts, shared, strict=True):
            digests, found = anchored(word_hashes(normal_words(text)))
            at = np.flatnonzero(np.isin(found, np.array(held, np.int64)))
            yield i, part, digests[at], at

    every = spill(map_rows(texts, units, _UNITS), "units")
    wholes = spill(every.groupBy("whole").agg(F.min(F.struct("id", "part")).alias("k"), F.count("*").alias("n")), "whole-texts")
    keepers = wholes.select("whole", F.col("k.id").alias("id"), F.col("k.part").alias("part"))
    first = spill(every.join(keepers, ["whole", "id", "part"], "left_semi").dropDuplicates(["id", "part"]), "first-texts")
    copies = join_often(every.select("whole", "id", "part"), wholes.filter("n > 1"), "whole", "n").filter(F.col("id") > F.col("k.id")).select("id", "part")

    each = first.select("id", "part", F.explode("anchors").alias("digest"))
    common = spill(each.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "shared-anchors")
    shared = join_often(each, common, "digest", "n").groupBy("id", "part").agg(F.collect_list("digest").alias("shared"))  # a text's own anchors: bounded by its length
    shared = spill(shared.selectExpr("id of", "part of_part", "shared"), "texts-to-compare")
    some = likely(texts, shared.selectExpr("of id", "of_part part"), ["id", "part"], "left_semi")
    some = some.join(shared, (F.col("id") == F.col("of")) & (F.col("part") == F.col("of_part"))).select("id", "txt", "part", "shared")
    second = spill(map_rows(some, grams, _GRAMS), "grams")

    zipped = second.select("id", "part", F.explode(F.arrays_zip("digests", "firsts")).alias("g"))
    each = zipped.select("id", "part", F.col("g.digests").alias("digest"), F.col("g.firsts").alias("first"), F.lit(LEAST_WORDS).alias("size"))
    lines = first.select("id", "part", F.explode(F.arrays_zip("lines", "firsts", "sizes")).alias("g"))
    each = each.unionByName(lines.select("id", "part", F.col("g.lines").alias("digest"), F.col("g.firsts").alias("first"), F.col("g.sizes").alias("size")))
    # a gram may stand several times in the text that keeps it, so counts are of ids
    kept = spill(each.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("latest"), F.count("*").alias("n")).filter("latest > keeper").drop("latest"), "shared-units")
    others = join_often(each, kept, "digest", "n").filter("id > keeper").select("id", "part", F.struct("first", "size").alias("u"))
    own = first.select("id", "part", F.explode(F.arrays_zip("own_firsts", "own_sizes")).alias("g")).select("id", "part", F.struct(F.col("g.own_firsts").alias("first"), F.col("g.own_sizes").alias("size")).alias("u"))
    found = others.unionByName(own).withColumn("copy", F.lit(False)).unionByName(copies.select("id", "part", F.lit(None).cast("struct<first:int,size:int>").alias("u"), F.lit(True).alias("copy")))
    out = spill(found.groupBy("id", "part").agg(F.max("copy").alias("copy"), F.collect_set("u").alias("units")), "repeated-units")
    for table in (every, wholes, first, common, shared, second, kept):
        drop_folder(table)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS) -> DataFrame:
    """(id, text, removed_spans, n_removed, removed_chars, kept_chars) of each row of docs: the text without the removed spans.

    removed_spans lists start:end in the original text, comma-joined. Null texts are empty. Ties: the smallest id keeps a
    unit, and rows of one id are one document, which keeps what only it holds, repeated rows included; null ids rank last,
    and their repeats are kept. A word may stand in a text of any length; the work for a text grows in proportion to it.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    found = repeated_units(docs, id_col, text_col, line_words)
    rows = id_text(docs, id_col, text_col, _part(text_col))
    none = F.lit(None)
    rest = likely(rows, found, ["id", "part"], "left_anti").select("id", "txt", none.cast("boolean").alias("copy"), none.cast("array<struct<first:int,size:int>>").alias("units"))
    held = found.selectExpr("id of", "part of_part", "copy", "units")
    some = likely(rows, found, ["id", "part"], "left_semi").join(held, (F.col("id") == F.col("of")) & (F.col("part") == F.col("of_part")), "left").select("id", "txt", "copy", "units")
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("removed_spans", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in ("n_removed", "removed_chars", "kept_chars")),
    ])

    def fn(ids, texts, copies, units):
        for i, text, copy, held in zip(ids, texts, copies, units, strict=True):
            spans = [(u["first"], u["size"]) for u in held or ()]
            if copy:
                words = normal_words(text)
                spans = [(0, len(words))] if len(words) >= LEAST_WORDS else [u[1:] for u in line_units(text, words, line_words)]
            cut = removed(text, spans)
            edges = [0, *(x for c in cut for x in c), len(text)]
            kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cut else text
            yield i, kept, ",".join(f"{a}:{b}" for a, b in cut), len(cut), len(text) - len(kept), len(kept)

    return map_rows(rest.unionByName(some), fn, schema)
