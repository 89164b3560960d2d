"""Exact top-k by inner product: Voronoi k-nearest-neighbour join.

Queries and data are grouped by their nearest pivot. From each group's summary (radius, least distances to
the pivot) Cauchy-Schwarz gives an upper bound of any score between two groups and a lower bound of the
k-th best score of a query group; query tiles are replicated only to the groups that their bounds let in,
solved there by exact matrix products, and the local results are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphtrust.llm.common import OFTEN, small_batches
from graphtrust.runtime import drop_folder, spill

#: Rows of a data tile and of a query tile; pivots of a vector length at least (the cube root of its rows, if that is more).
DATA_TILE, QUERY_TILE, LEAST_PIVOTS = 2048, 512, 16


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, vec) with floor(scale * x) of each component; vectors that are null or hold null or non-finite components, and null ids, go."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vec"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; in doubles where all sums stay below 2**53."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q @ v.T


def _group_pairs(pivots: np.ndarray, data: pd.DataFrame, asks: pd.DataFrame, k: int) -> list[tuple[int, int]]:
    """(query group, data group) pairs that may hold one of a query's k best. Frames: grp, radius and near (least distances)."""
    slack = 1e-6 * (1 + float(np.abs(pivots).max(initial=0)) ** 2)
    norms = np.linalg.norm(pivots, axis=1)
    h, rd = data["grp"].to_numpy(int), data["radius"].to_numpy(float)
    at = np.repeat(np.arange(len(h)), [len(x) for x in data["near"]])
    near = np.concatenate([np.asarray(x, float) for x in data["near"]]) if len(data) else np.zeros(0)
    pairs = []
    for g, ra in zip(asks["grp"].to_numpy(int), asks["radius"].to_numpy(float), strict=True):
        dot = pivots[h] @ pivots[g]
        most = dot + norms[g] * rd + ra * norms[h] + ra * rd
        floor = (dot - ra * norms[h])[at] - (norms[g] + ra) * near
        least = np.partition(floor, len(floor) - k - 1)[len(floor) - k - 1] if len(floor) > k else -np.inf  # one more than k: the query itself is among them
        pairs += [(int(g), int(x)) for x in h[most >= least - slack]]
    return pairs


def _solve(dim: int, q: tuple, v: tuple, k: int) -> pd.DataFrame:
    """The k best of a data tile for each query of a query tile. Tiles: (rows, ids, matrix), as bytes; data is ordered by id."""
    (qrow, qid, qm), (vrow, vid, vm) = (tuple(np.frombuffer(x, np.int64) for x in t) for t in (q, v))
    s = _scores(qm.reshape(len(qid), dim), vm.reshape(len(vid), dim))
    n = len(vid) - k - 1  # one more than k: the query itself may be among them
    i, j = np.nonzero(s >= np.partition(s, n, axis=1)[:, n : n + 1]) if n > 0 else np.nonzero(np.ones(s.shape, bool))
    other = qrow[i] != vrow[j]
    i, j = i[other], j[other]
    score = s[i, j]
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return pd.DataFrame({"query_row": qrow[i[best]], "query_id": qid[i[best]], "vec_id": vid[j[best]], "score": score[best]})


def top_k(data: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every query row of data (id, vec of longs).

    A query row doesn't meet itself; other rows of its id are candidates like any, so repeated query rows have each their own
    k best, and repeated candidates count each. Ties go to the smaller id. Only vectors of the query's length are compared, be
    they very long; other columns are ignored. Fewer candidates than k: all of them. An empty table: no rows.

    Pivots (None: the cube root of a length's rows, LEAST_PIVOTS at least) are vectors with the least hashes of their ids.
    A length of at most one row in OFTEN has none and is compared in tiles as it is, so the driver holds fewer than OFTEN
    lengths' pivots.
    """
    spark, none = data.sparkSession, "query_id long, rank int, vec_id long, score long"
    data = spill(small_batches(data).select("id", "vec", F.size("vec").alias("dim"), is_query.alias("ask"), F.monotonically_increasing_id().alias("row")), "vectors")
    sizes = data.groupBy("dim").agg(F.count("*").alias("n"))
    total = data.count()
    if not total:
        return spark.createDataFrame([], none)
    large = sizes.filter(F.col("n") * OFTEN > total).withColumn("most", F.lit(pivots) if pivots else F.greatest(F.lit(LEAST_PIVOTS), F.round(F.cbrt("n")).cast("int")))  # fewer than OFTEN rows
    ranked = data.join(F.broadcast(large), "dim").withColumn("p", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "row")))
    by_dim: dict[int, list] = {}
    for r in ranked.filter((F.col("p") <= F.col("most")) & (F.col("p") <= int(max(LEAST_PIVOTS, pivots or 0, total ** (1 / 3) + 1)))).select("dim", "vec").collect():
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    centres = {d: np.array(v, float).reshape(len(v), d) for d, v in by_dim.items()}

    def assign(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=True):
                v, c = _matrix(part["vec"]).astype(float), centres.get(int(dim))
                grp, dist = np.zeros(len(v), int), np.zeros(len(v))
                if dim and c is not None:
                    grp = ((c**2).sum(axis=1) - 2 * v @ c.T).argmin(axis=1)
                    dist = np.sqrt(((v - c[grp]) ** 2).sum(axis=1))
                yield part.assign(grp=grp.astype("int32"), dist=dist)[["id", "vec", "dim", "ask", "row", "grp", "dist"]]

    grouped = spill(data.mapInPandas(assign, "id long, vec array<long>, dim int, ask boolean, row long, grp int, dist double"), "grouped-vectors")
    drop_folder(data)
    asks = grouped.filter("ask")
    known = F.broadcast(spark.createDataFrame([(d,) for d in centres] or [(-1,)], "dim int"))

    def summary(rows: DataFrame) -> pd.DataFrame:
        rows = rows.join(known, "dim", "left_semi")
        near = rows.withColumn("n", F.row_number().over(Window.partitionBy("dim", "grp").orderBy("dist", "row"))).filter(F.col("n") <= k + 1)
        return (
            rows.groupBy("dim", "grp").agg(F.max("dist").alias("radius"), F.count("*").alias("n"))
            .join(near.groupBy("dim", "grp").agg(F.collect_list("dist").alias("near")), ["dim", "grp"]).toPandas()
        )  # a row for each pivot

    held, asked = summary(grouped), summary(asks)
    pairs = [
        (int(d), g, h)
        for d in sorted(centres)
        for g, h in _group_pairs(centres[d], held[held["dim"] == d], asked[asked["dim"] == d], k)
    ]
    rare = -(-total // OFTEN)  # rows of a length without pivots at most

    def in_tiles(rows: DataFrame, counts: pd.DataFrame, size: int) -> DataFrame:
        """rows with `tiles`, the number of tiles of their group, and their own, dealt by a hash."""
        n = [(int(r.dim), int(r.grp), max(1, -(-int(r.n) // size))) for r in counts.itertuples()]
        table = F.broadcast(spark.createDataFrame(n, "dim int, grp int, tiles int"))  # a row for each pivot
        rows = rows.join(table, ["dim", "grp"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(max(1, -(-rare // size)))))
        return rows.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")) if "row" in rows.columns else rows

    def packed(rows: DataFrame, counts: pd.DataFrame, size: int, prefix: str) -> DataFrame:
        """A row of bytes for each tile."""

        def pack(key, pdf):
            pdf = pdf.sort_values(["id", "row"], kind="stable")
            return pd.DataFrame({"dim": [key[0]], "grp": [key[1]], "tile": [key[2]], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "m": [_matrix(pdf["vec"]).tobytes()]})

        tiles = in_tiles(rows.select("id", "vec", "dim", "grp", "row"), counts, size).groupBy("dim", "grp", "tile").applyInPandas(pack, "dim int, grp int, tile int, rows binary, ids binary, m binary")
        return tiles.withColumnsRenamed({c: prefix + c for c in ("rows", "ids", "m")})

    let_in = F.broadcast(spark.createDataFrame(pairs, "dim int, qgrp int, to int"))  # at most the squares of the pivots
    ask_tiles = packed(asks, asked, QUERY_TILE, "q").withColumnRenamed("grp", "qgrp").drop("tile").join(let_in, ["dim", "qgrp"], "left")
    ask_tiles = ask_tiles.select("dim", F.coalesce("to", "qgrp").alias("grp"), "qrows", "qids", "qm")
    ask_tiles = in_tiles(ask_tiles, held, DATA_TILE).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    joined = ask_tiles.join(packed(grouped, held, DATA_TILE, "v"), ["dim", "grp", "tile"])

    def solve(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield _solve(r.dim, (r.qrows, r.qids, r.qm), (r.vrows, r.vids, r.vm), k)

    local = joined.select("dim", "qrows", "qids", "qm", "vrows", "vids", "vm").mapInPandas(solve, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
