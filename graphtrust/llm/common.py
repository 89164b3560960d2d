"""What the operators share: Arrow batch plumbing over id and text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 200
#: A key of more than one in so many rows is joined by broadcast, so that no task gathers its rows.
OFTEN = 4096
#: likely() tells by at most so many residues of a hash.
RESIDUES = 1 << 20


_powers = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd 64-bit factor, by which places in a word are told apart; made anew, twice as many, for a longer word."""
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64))
    return _powers


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to BATCH_ROWS, unless it is lower already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The two needed columns under our own names, so that other columns can't clash; a null text is empty."""
    return small_batches(docs).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"), *more
    )


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: T.StructType, as_bytes: bool = False) -> DataFrame:
    """mapInArrow where fn gets a batch's columns as lists and yields row tuples of the schema.

    as_bytes: strings come as their UTF-8 bytes. A large result is passed on in several batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            columns = [(c.cast(pa.binary()) if as_bytes and pa.types.is_string(c.type) else c).to_pylist() for c in batch.columns]
            rows: list = []
            for row in fn(*columns):
                rows.append(row)
                if len(rows) >= 20_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return df.mapInArrow(run, schema)


def join_often(rows: DataFrame, counts: DataFrame, key: str, n_col: str) -> DataFrame:
    """rows joined with counts, a written table that has a row for each key and in n_col how many rows the key has.

    Frequent keys, of which there are fewer than OFTEN, come by broadcast and all others by a shuffle. n_col is dropped.
    """
    total = counts.agg(F.coalesce(F.sum(n_col), F.lit(0))).first()[0]
    often = F.col(n_col) * OFTEN > total
    hot = F.broadcast(counts.filter(often).drop(n_col))
    rest = rows.join(hot.select(key), key, "left_anti").join(counts.filter(~often).drop(n_col), key)
    return rows.join(hot, key).unionByName(rest)


def likely(rows: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows that may be (left_semi) or surely aren't (left_anti) among found's by their keys, so that only the former need be moved to join them.

    At most RESIDUES residues of a hash are broadcast; where found has many more rows than that, nearly all rows are likely.
    """
    residue = F.pmod(F.xxhash64(*keys), F.lit(RESIDUES))
    few = F.broadcast(found.select(residue.alias("_residue")).distinct())
    return rows.withColumn("_residue", residue).join(few, "_residue", how).drop("_residue")
