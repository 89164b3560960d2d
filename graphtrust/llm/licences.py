"""License scans by diagonal voting.

The hash of every rolling word k-gram of a text is joined in Spark to the k-gram positions of the license templates, whole
texts of the short licenses and notices of the long ones; matches vote for the diagonal (text position less template
position); votes are aggregated by diagonal; neighbouring diagonals, where words were put in or left out, are merged; a
merged span is verified by the share of the template it covers and its length.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtrust.llm.common import id_text, map_rows, powers

#: Phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of the method's own labels, words only: texts of public licenses, whole where they are short, and notices.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an"
        " as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and"
        " limitations under the license",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice"
        " shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied"
        " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright"
        " holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the"
        " software or the use or other dealings in the software",
    ),
    "bsd": (
        "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of"
        " source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the"
        " above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither"
        " the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior"
        " written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to"
        " the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable"
        " for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of"
        " use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or"
        " otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and"
        " this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all"
        " implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages"
        " whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with"
        " the use or performance of this software",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this"
        " software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"
        " subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you"
        " use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly"
        " marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either"
        " in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "gpl": (
        "under the terms of the gnu general public license",
        "gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any"
        " warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should"
        " have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ),
    "cc-by": (
        "licensed under a creative commons attribution 4 0 international license",
        "this work is licensed under cc by 4 0",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"
        " http mozilla org mpl 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
}
#: Words of a k-gram; diagonals that are merged; least share of a template's k-grams; longest span against the template's length.
GRAM, NEIGHBOURS, LEAST_SHARE, LONGEST = 3, 3, 0.75, 1.5
#: Bytes that don't make words become spaces; A-Z are lower-cased.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
#: The gram that stands for the text itself, so that texts without a match come through the join too.
_HEAD = 0
_PHRASE_WORDS = {tuple(phrase.encode().split()): label for phrase, label in PHRASES.items()}


def word_hashes(folded: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose other bytes are spaces."""
    raw = np.frombuffer(folded, np.uint8)
    solid = np.flatnonzero(raw != 32)
    if not len(solid):
        return np.zeros(0, np.uint64)
    begins = np.concatenate([[True], np.diff(solid) > 1])
    first = np.flatnonzero(begins)
    size = np.diff(np.concatenate([first, [len(solid)]]))
    place = np.arange(len(solid)) - np.repeat(first, size)
    h = np.add.reduceat(raw[solid].astype(np.uint64) * powers(int(size.max()))[place], first)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each rolling k-gram of words; never that of _HEAD."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + hashes[k : n + k]
    return (out | np.uint64(1)).view(np.int64)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in _PHRASE_WORDS.items():
        if phrase[0] not in words:
            continue
        n, at = len(phrase), -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if tuple(words[at : at + n]) == phrase:
                found.append((at, label))
    return sorted(found)


_LABELS = tuple(sorted(set(PHRASES.values())))


def _flat(templates: Mapping[str, tuple[str, ...]]) -> list[tuple[str, np.ndarray]]:
    """(label, k-gram hashes) of each template, in order."""
    return [(label, gram_hashes(word_hashes(text.encode().translate(_FOLD)))) for label, texts in templates.items() for text in texts]


def merged_spans(lines: list[dict], length: int) -> list[tuple[int, int, float]]:
    """(start, stop, share) of verified spans of one text and template, from its diagonals (diagonal, start, stop, and hit: the positions as bits).

    Diagonals are taken in order; one joins the last while it is a neighbour and the span stays short enough.
    """
    spans: list[list] = []
    for d in sorted(lines, key=lambda d: (d["diagonal"], d["start"])):
        last = spans[-1] if spans else None
        if last and d["diagonal"] - last[3] <= NEIGHBOURS and max(d["stop"], last[1]) - min(d["start"], last[0]) <= LONGEST * length:
            last[0], last[1], last[3] = min(last[0], d["start"]), max(last[1], d["stop"]), d["diagonal"]
            last[2] |= d["hit"]
        else:
            spans.append([d["start"], d["stop"], d["hit"], d["diagonal"]])
    whole = length - GRAM + 1
    return sorted((a, b, hit.bit_count() / whole) for a, b, hit, _ in spans if hit.bit_count() >= LEAST_SHARE * whole and b - a <= LONGEST * length)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, license_spans) of each row.

    labels: the base labels and those of verified spans. score: 1 where a base phrase stands, else the largest share
    of a template that a verified span covers, else 0. license_spans: (start, stop, label, share), in words, by start.
    Templates: words by label, each of GRAM words at least.

    Null texts are empty: no words, no spans. Repeated rows and null ids are scanned each for itself. A very long text is
    scanned whole, each k-gram a row of its own. Ties: a span of two templates is listed for both; of diagonals that
    could be merged either way the lesser goes first. Other columns are ignored, whatever their names; an empty table gives
    no rows.
    """
    flat = _flat(templates)
    counts = ("id", "n_words", "n_base", "first_word", "last_word", "base_mask")
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in counts), T.StructField("grams", T.ArrayType(T.LongType()))])

    def grams(ids, texts):
        for i, text in zip(ids, texts, strict=True):
            folded = text.translate(_FOLD)
            words = folded.split()
            base = phrase_places(words)
            starts, mask = [p for p, _ in base], sum(1 << _LABELS.index(x) for x in {x for _, x in base})
            yield i, len(words), len(base), min(starts, default=None), max(starts, default=None), mask, np.concatenate([[_HEAD], gram_hashes(word_hashes(folded))])

    spark = docs.sparkSession
    positions = [(_HEAD, None, None), *((int(g), n, p) for n, (_, hashes) in enumerate(flat) for p, g in enumerate(hashes))]
    table = F.broadcast(spark.createDataFrame(positions, "gram long, template int, at int"))  # the templates' words bound it
    rows = map_rows(id_text(docs, id_col, text_col), grams, schema, as_bytes=True).select(F.monotonically_increasing_id().alias("row"), *counts, "grams")
    votes = rows.select("row", *counts, F.posexplode("grams").alias("place", "gram")).join(table, "gram").withColumn("place", F.col("place") - 1)
    # positions hit are kept as bits, so that all of a vote's state is of fixed width
    parts = range(-(-max((len(hashes) for _, hashes in flat), default=1) // 63))
    bits = [F.bit_or(F.when(F.floor(F.col("at") / 63) == k, F.expr("shiftleft(1L, at % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"hit{k}") for k in parts]
    own = [F.max(F.when(F.col("template").isNull(), F.col(c))).alias(c) for c in counts]
    lines = votes.groupBy("row", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.min("place").alias("start"), (F.max("place") + GRAM).alias("stop"), *bits, *own)
    one = F.struct("template", "diagonal", "start", "stop", *[f"hit{k}" for k in parts])
    texts = lines.groupBy("row").agg(*[F.max(c).alias(c) for c in counts], F.collect_list(F.when(F.col("template").isNotNull(), one)).alias("lines"))  # a text's own matches only: bounded by its length
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])
    longs = [T.StructField(c, T.LongType()) for c in counts[:5]]
    out = T.StructType([*longs, T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("license_spans", T.ArrayType(span))])

    def verify(ids, n_words, n_base, first, last, masks, lines):
        for i, words, places, a, z, mask, found in zip(ids, n_words, n_base, first, last, masks, lines, strict=True):
            by_template: dict[int, list] = {}
            for d in found:
                d["hit"] = sum(d[f"hit{k}"] << 63 * k for k in parts)
                by_template.setdefault(d["template"], []).append(d)
            spans = sorted((p, q, flat[t][0], share) for t, ds in by_template.items() for p, q, share in merged_spans(ds, len(flat[t][1]) + GRAM - 1))
            base = [x for k, x in enumerate(_LABELS) if mask >> k & 1]
            labels = sorted({*base, *(s[2] for s in spans)})
            score = 1.0 if places else max((s[3] for s in spans), default=0.0)
            yield i, words, places, a, z, ",".join(base), ",".join(labels), score, [dict(zip(("start", "stop", "label", "share"), s, strict=True)) for s in spans]

    return map_rows(texts.select(*counts, "lines"), verify, out)
