"""Packing: concatenate and cut, with two passes of prefix sums.

Pass 1 tokenizes each partition in order and writes ids with each document's offset in its partition; the partitions'
totals (a row for each) are summed on the driver into global offsets. Pass 2 cuts the one long sequence into windows;
a document that crosses a window's end has a piece in each window, which keeps its place (start) and its document.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenizers import Tokenizer

from graphtrust.llm.common import id_text, map_rows
from graphtrust.runtime import spill

#: Tokens of a sequence; the id that ends a document; the tokenizer's file and the same vocabulary as ranks.
WINDOW, END_ID, TOKENIZER, RANKS = 2048, 1, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts whose ids are handed on together.
STEP_ROWS = 100
#: White space but for the space and the line feed.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_PAIRS = ("  ", "\n\n", " \n", "\n ", "<|")


class PlainEncoder:
    """Ids of a text as little-endian 16-bit numbers, equal to the tokenizers library's.

    Texts whose white space is single spaces and line feeds between words are encoded by the same vocabulary's ranks and
    pattern; texts with other white space or a special token's beginning go to the tokenizers library, which is slower.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        self.whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or any(p in text for p in _PAIRS) or any(c in text for c in _SPACES):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return np.array(self.plain.encode_ordinary(text), "<u2").tobytes()


_encoder: list[PlainEncoder] = []


def encoder() -> PlainEncoder:
    if not _encoder:
        _encoder.append(PlainEncoder())
    return _encoder[0]


def cut(start: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset there) of the pieces of a document that begins at a global offset."""
    out, at = [], 0
    while at < length:
        sequence, offset = divmod(start + at, WINDOW)
        n = min(WINDOW - offset, length - at)
        out.append((at, n, sequence, offset))
        at += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; only the last sequence has padding.

    Each document ends with END_ID, so a null or empty text has one token. Rows of one id, or without one, are separate documents. A very
    long text is encoded whole and cut into as many pieces as it takes. There are no ties: documents follow one another as
    they are read and written. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("before", T.LongType())])

    def tokenize(batches):
        encode, end, before = encoder(), np.array([END_ID], "<u2").tobytes(), 0
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, len(ids), STEP_ROWS):  # ids of few texts at a time
                tokens = [encode(t) + end for t in texts[at : at + STEP_ROWS].to_pylist()]
                ahead = np.cumsum([before] + [len(t) // 2 for t in tokens])
                before = int(ahead[-1])
                yield pa.RecordBatch.from_arrays([ids[at : at + STEP_ROWS], pa.array(tokens, pa.binary()), pa.array(ahead[:-1], pa.int64())], names=["id", "tokens", "before"])

    # the partition's number is written with its rows, so later passes depend on no partitioning
    kept = spill(id_text(docs, id_col, text_col).mapInArrow(tokenize, schema).withColumn("part", F.spark_partition_id()), "token-ids")
    length = (F.octet_length("tokens") / 2).cast("long")
    totals = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.sum(length).alias("n")).collect()}  # a row for each partition
    offsets, ahead = {}, 0
    for part in sorted(totals):
        offsets[part], ahead = ahead, ahead + totals[part]
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def pieces(ids, tokens, befores, parts):
        for i, raw, before, part in zip(ids, tokens, befores, parts, strict=True):
            wide = np.frombuffer(raw, "<u2").astype("<u4")
            for start, n, sequence, offset in cut(offsets[part] + before, len(wide)):
                yield i, start, n, zlib.crc32(wide[start : start + n]), len(wide), sequence, offset

    return map_rows(kept, pieces, out)
