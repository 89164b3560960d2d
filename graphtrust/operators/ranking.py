"""Deduplication by priority, deterministic sampling, quotas, splits and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphtrust.runtime import spill


def draw(key: str, seed: int) -> Column:
    """A reproducible random order of a key."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def keep_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def prefix_sums_of(df: DataFrame, weights: dict[str, Column], *order: Column | str) -> DataFrame:
    """df with a column for each of weights (name: weight): the sum over all rows ahead of a row in a total order.

    Ranges are sorted by many tasks, and their totals (a row for each) summed.
    """
    own = {name: f"_w{k}" for k, name in enumerate(weights)}
    rows = spill(df.withColumns({own[name]: w for name, w in weights.items()}).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in own.values()])
    ahead = totals.select("_range", *[(F.sum(c).over(Window.orderBy("_range")) - F.col(c)).alias(f"_ahead{c}") for c in own.values()])
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_inside{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in own.values()}).join(F.broadcast(ahead), "_range")
    return rows.select(*df.columns, *[(F.col(f"_ahead{c}") + F.col(f"_inside{c}")).alias(name) for name, c in own.items()])


def prefix_sums(df: DataFrame, weight: Column, *order: Column | str) -> DataFrame:
    """df with `before`, as prefix_sums_of."""
    return prefix_sums_of(df, {"before": weight}, *order)


def ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank of value, the largest first, equals sharing the least: counted by distinct values, so ties aren't one task's."""
    counts = df.groupBy(value).agg(F.count("*").alias("_k"))
    at = prefix_sums(counts, F.col("_k"), F.desc(value)).select(value, (F.col("before") + 1).cast("long").alias(name))
    return df.join(at, value)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows."""
    return df.orderBy(draw(key, seed), key).limit(max(0, n))


def first_by(df: DataFrame, code: Column, ties: tuple[str, ...], n: int) -> DataFrame:
    """The n rows of least code (hexadecimal digits, evenly spread), ties by the columns named: rows are counted by three digits, so that only those of one count are sorted."""
    rows = df.withColumn("_code", code).withColumn("_front", F.substring("_code", 1, 3))
    held, last = 0, None
    for front, k in sorted(map(tuple, rows.groupBy("_front").count().collect())) if n > 0 else ():  # 4,096 rows
        if held + k > n:
            last = front
            break
        held += k
    if n <= 0 or last is None:
        return df.limit(0) if n <= 0 else df
    edge = rows.filter(F.col("_front") == last).orderBy("_code", *ties).limit(n - held)
    return rows.filter(F.col("_front") < last).unionByName(edge).select(df.columns)


def ranked_within(df: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """df with `place`, from 1, of each row in its group in a total order, and `group_size`: by one range sort, so no task holds a group."""
    rows = prefix_sums(df, F.lit(1), group, *order)
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.min("before").alias("_start"), F.count("*").alias("group_size"))
    rows = rows.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    return rows.withColumn("place", F.col("before") - F.col("_start") + 1).drop("_group", "_start", "before")


def quota_sample(df: DataFrame, key: str, group: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Up to each group's quota of rows, then one row for each key (of the first group by name)."""
    some = reduce(DataFrame.unionByName, [sample(df.filter(F.col(group) == name), key, n, seed) for name, n in quotas.items()])  # a task keeps a quota of each group at most
    return keep_first(some, key, F.col(group))


def exclusive_groups(pools: list[tuple[str, DataFrame, int, int]], key: str) -> DataFrame:
    """One group after another, each a sample (name, rows, n, seed) of the keys that no earlier group holds."""
    taken: list[DataFrame] = []
    for name, rows, n, seed in pools:
        left = reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), taken, rows)
        taken.append(sample(left.select(key), key, n, seed).withColumn("selection_group", F.lit(name)))
    return reduce(DataFrame.unionByName, taken)


def stratified_split(df: DataFrame, key: str, label: str, seed: int, parts: tuple[tuple[str, float], ...]) -> DataFrame:
    """A part for each row, in these shares of each label."""
    rows = ranked_within(df, label, draw(key, seed), key)
    share = (F.col("place") - 1) / F.col("group_size")
    at, when = 0.0, None
    for name, size in parts:
        at += size
        when = F.when(share < at, name) if when is None else when.when(share < at, name)
    return rows.withColumn("part", when.otherwise(parts[-1][0])).drop("place", "group_size")


def stratified_cap(df: DataFrame, key: str, label: str, most: int, seed: int) -> DataFrame:
    """About `most` rows, each label in its share (rounded, at least one)."""
    rows = ranked_within(df, label, draw(key, seed), key)
    total = df.agg(F.count("*").alias("_total"))
    cap = F.greatest(F.lit(1), F.floor(F.col("group_size") * most / F.col("_total") + 0.5))
    return rows.crossJoin(F.broadcast(total)).filter(F.col("place") <= cap).drop("place", "group_size", "_total")  # one row


def chunks(df: DataFrame, order: str, size_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    """A chunk number for each row in order: a new one where rows or bytes would pass a cap. The running sum starts anew, so one task walks the order of (order, size)."""

    def walk(batches):
        chunk = rows = held = 0
        for pdf in batches:
            numbers = []
            for size in pdf[size_col]:
                if rows and (rows >= most_rows or held + size > most_bytes):
                    chunk, rows, held = chunk + 1, 0, 0
                rows, held = rows + 1, held + size
                numbers.append(chunk)
            yield pdf.assign(chunk=numbers)

    some = df.select(F.col(order), F.col(size_col).cast("long"))
    kind = dict(some.dtypes)[order]
    return some.repartition(1).sortWithinPartitions(order).mapInPandas(walk, f"{order} {kind}, {size_col} long, chunk long")
