"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document has expected copies target / size of its source; they are summed along a fixed order within the source
(by size, so that the words taken come near the target), one random offset is added, and a copy is emitted for each
integer boundary crossed. The prefix sums take two levels, source bucket and rows of a bucket, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphtrust.operators.ranking import prefix_sums, prefix_sums_of
from graphtrust.runtime import spill

#: The weights that the sources take in turn; the share of all words that is mixed; the most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Sub-buckets of a size class; the offset's seed.
DEALS, SEED = 64, "mix-1"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from a row for each source (source, source_size).

    Sources by code point, null last, take WEIGHTS in turn. With the total T to share, each gets min(MOST * size, level * weight),
    where the level makes the sum T: the fixed point of resharing what is above a cap. The level is that of the first
    source, by cap / weight, whose cap isn't reached. Sums run over ranges of sources, so there may be many.
    """
    last = F.col("source").asc_nulls_last()
    ranked = prefix_sums(sizes, F.lit(1), last)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod("before", F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = ranked.select("source", "source_size", weight.alias("weight"), (MOST * F.col("source_size")).alias("cap"))
    rows = prefix_sums_of(rows, {"caps": F.col("cap"), "weights": F.col("weight")}, F.col("cap") / F.col("weight"), last)
    whole = rows.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("level", (SHARE * F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights")))  # one row
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level"))))
    rows = rows.crossJoin(F.broadcast(rows.agg(free.alias("first"))))  # one row
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("first.level") * F.col("weight")), F.col("cap")).alias("target"))


def _size_class(size: Column) -> Column:
    """Sizes below 16 are classes of their own; larger ones share one with those of their power of two and eighth."""
    digits = F.length(F.bin(size))
    return F.when(digits <= 4, size).otherwise((digits * 8).cast("long") + F.floor(size / F.pow(F.lit(2.0), digits - 4)) % 8).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of each row of docs; reruns agree.

    A null text has size 0; null sources are a source of their own, the last; null ids come first in the order, and repeated
    rows are neighbours in it. Ties in size go by id. A very long text counts whole, as one document. No words at all: targets
    of 0. `keep` names columns of docs to carry along, in a struct `kept`, so no name can clash. An empty table: no rows.
    """
    # the array holds the count, so that it is made once a row however often the class asks for it
    measured = F.transform(F.array(word_count(F.col(text_col))), lambda n: F.struct(n.alias("size"), _size_class(n).alias("class")))[0].alias("m")
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), measured, *kept)
    rows = rows.select("id", "source", "m.size", "m.class", *(["kept"] if keep else []), F.pmod(F.coalesce("id", F.lit(0)), F.lit(DEALS)).cast("int").alias("deal"))
    key = ["source", "class", "deal"]
    buckets = spill(rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-buckets")  # so that texts are read for it once
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("class", "deal").rowsBetween(Window.unboundedPreceding, -1)
    prefix = buckets.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "words")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.lit(":"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # a null source is told from an empty one by a flag, so that plain equalities join them
    plain = lambda df, a: df.withColumns({f"{a}_null": F.col("source").isNull(), f"{a}_source": F.coalesce("source", F.lit(""))}).drop("source")
    left = plain(rows.withColumn("within", F.row_number().over(Window.partitionBy(*key).orderBy("size", "id"))), "s")
    level = plain(prefix.withColumn("offset", offset), "s").join(plain(sources, "s"), ["s_null", "s_source"])
    joined = left.join(level, ["s_null", "s_source", "class", "deal"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = (F.col("before") + F.col("within")).cast("double")
    copies = F.floor(each * place + F.col("offset")) - F.floor(each * (place - 1) + F.col("offset"))
    return joined.withColumn("copies", copies.cast("long")).select(
        "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else [])
    )
