"""SimHash near-duplicates: tiled exact comparison of distinct fingerprints, of all or of those whose texts share a shingle.

Fingerprints are cut into blocks of close population counts; pairs of blocks, and inside them pairs of
tiles, whose population counts differ by more than the radius are skipped, all others are compared by
exclusive or and bit counts. A block travels as one row of bytes, and each pair of blocks returns only a spanning
forest of the links found, so a group of n near copies costs O(n) rows, and no link between different texts is lost.

That work grows with the square of the rows. Where a text's sketch (its least shingle hashes) goes along, fingerprints
are compared if their sketches share a shingle, see sharing_links(); the work then follows the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtrust.llm.common import id_text, join_often, likely, map_rows, small_batches
from graphtrust.operators.components import connected_components
from graphtrust.runtime import drop_folder, spill

#: Fingerprints of a block at most, but for the chance of a hash; blocks at least, for parallel work; rows of a tile; tasks that compare at most.
BLOCK_ROWS, LEAST_BLOCKS, TILE_ROWS, MOST_TASKS = 16_384, 8, 512, 4096
#: Stands for a null id, ranked last.
NO_ID = 2**63 - 1
_CHUNK = 65_536  # shingles whose bits are counted at once
#: Shingles of a sketch; texts, in the mean, by which shingles are ordered; frequent shingles at most; shingles of a bucket, and those dealt to buckets at once.
SKETCH, SAMPLE_TEXTS, MOST_FREQUENT, BUCKET_ROWS, DEAL_ROWS = 64, 16_384, 65_536, 1 << 18, 1 << 18
#: A pair to be found shares more than one in so many shingles of either sketch.
SHARED = 16
_SMALL = 64  # rows of a group whose pairs are listed
FINGERPRINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("pop", T.IntegerType())])


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words (ASCII white space separates, A-Z lower-cased), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 * words bits, each set where more than half of the hashes have it; further words use remixed hashes. None: zero."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        for k in range(words):
            mixed = part
            if k:
                mixed = part * np.uint64(2 * k + 0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1, distinct: bool = False, row: Column | None = None, sketch: int = 0) -> DataFrame:
    """(id, row, fp, pop) of each row: fingerprint in lowercase hex and its population count. Null or empty text: zero.

    distinct: a shingle counts once, however often it stands in the text. row: a number that tells rows apart, else null.
    sketch: if not zero, a column of that name holds the text's so many least distinct hashes, 8 bytes each.
    """
    schema = T.StructType([*FINGERPRINT.fields, T.StructField("sketch", T.BinaryType())]) if sketch else FINGERPRINT

    def fn(ids, texts, rows):
        for i, text, r in zip(ids, texts, rows, strict=True):
            hashes = shingle_hashes(text, width)
            once = np.unique(hashes) if distinct or sketch else hashes
            fp = fingerprint(once if distinct else hashes, words)
            found = i, r, fp.hex(), int.from_bytes(fp, "big").bit_count()
            yield (*found, once[:sketch].astype("<u8").tobytes()) if sketch else found

    number = F.lit(None) if row is None else row
    return map_rows(id_text(docs, id_col, text_col, number.cast("long").alias("number")), fn, schema, as_bytes=True)


def _fold(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the pairs (a, b) in the forest `parent`, whose every node points at its least."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by population counts, tile starts, and the least and greatest counts of each tile (whole, then by 16 bits)."""
    parts = np.bitwise_count(fps.view(np.uint16).reshape(len(fps), -1)).astype(np.int32)
    counts = np.column_stack([parts.sum(axis=1), parts])
    order = np.lexsort(counts.T[::-1])
    starts = np.arange(0, len(fps), TILE_ROWS)
    ordered = counts[order]
    return order, starts, np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts)


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y at most `radius` bits apart.

    As many words are compared for all rows as keep unrelated ones, 32 bits a word apart, five deviations beyond the radius; the
    rest are only looked at where these allow it.
    """
    words = x.shape[1]
    dense = next((w for w in range(1, words) if 32 * w - radius >= 20 * w**0.5), words)
    distance = np.bitwise_count(x[:, :1] ^ y[None, :, 0])
    if 64 * dense > 255:
        distance = distance.astype(np.uint16)
    for w in range(1, dense):
        distance += np.bitwise_count(x[:, w : w + 1] ^ y[None, :, w])
    i, j = np.nonzero(distance <= radius)
    if dense < words and len(i):
        close = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int32) <= radius
        i, j = i[close], j[close]
    return i, j


def links_within(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest, as (node, root) rows, of the links between two blocks of fingerprints, or inside one.

    Fingerprints are rows of 64-bit words; nodes of `right` are numbered after those of `left`.
    """
    shift = 0 if right is None else len(left)
    lo = _tiles(left)
    hi = lo if right is None else _tiles(right)
    x, y = left[lo[0]], (left if right is None else right)[hi[0]]
    parent = np.arange(shift + len(y))
    held_a, held_b, held = [], [], 0
    for s, start in enumerate(lo[1]):
        gap = np.maximum(0, np.maximum(hi[2] - lo[3][s], lo[2][s] - hi[3]))
        meet = (gap[:, 0] <= radius) & (gap[:, 1:].sum(axis=1) <= radius)
        for t in np.flatnonzero(meet):
            if right is None and t < s:
                continue
            i, j = _near(x[start : start + TILE_ROWS], y[hi[1][t] : hi[1][t] + TILE_ROWS], radius)
            if len(i):
                held_a.append(lo[0][start + i])
                held_b.append(shift + hi[0][hi[1][t] + j])
                held += len(i)
                if held > 1_000_000:
                    _fold(parent, np.concatenate(held_a), np.concatenate(held_b))
                    held_a, held_b, held = [], [], 0
    if held:
        _fold(parent, np.concatenate(held_a), np.concatenate(held_b))
    nodes = np.flatnonzero(parent != np.arange(len(parent)))
    return np.column_stack([nodes, parent[nodes]])


def plan_blocks(histogram: dict[int, int], radius: int) -> list[tuple[int, int, int, int, int]]:
    """(population count, first block, blocks, first and last block to meet) for each count; blocks follow the counts.

    Neighbouring counts share a block while it holds at most BLOCK_ROWS rows; a frequent count is dealt to several.
    """
    most = max(1, min(BLOCK_ROWS, -(-sum(histogram.values()) // LEAST_BLOCKS)))
    place: dict[int, tuple[int, int]] = {}
    spans: list[tuple[int, int]] = []
    held = most + 1
    for pop in sorted(histogram):
        n = -(-histogram[pop] // most)
        if n > 1 or held + histogram[pop] > most:
            place[pop] = (len(spans), n)
            spans += [(pop, pop)] * n
            held = most + 1 if n > 1 else histogram[pop]
        else:
            place[pop] = (len(spans) - 1, 1)
            spans[-1] = (spans[-1][0], pop)
            held += histogram[pop]
    rows = []
    for pop, (first, n) in place.items():
        low, high = spans[first]
        meet = [k for k, (a, b) in enumerate(spans) if a - high <= radius and low - b <= radius]
        rows.append((pop, first, n, meet[0], meet[-1]))
    return rows


def similar_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(src, dst) nodes (first, fp): a forest that spans every link among the distinct (fp, pop, first) rows; a null `first` ranks last."""
    histogram = {r["pop"]: r["count"] for r in distinct.groupBy("pop").count().collect()}  # at most one row for each bit and one
    plan = plan_blocks(histogram, radius)
    lookup = lambda k: F.create_map(*[F.lit(v) for r in plan for v in (r[0], r[k])])[F.col("pop")]
    if not plan:
        return distinct.select(_node("first", "fp").alias("src"), _node("first", "fp").alias("dst")).limit(0)
    block = (lookup(1) + F.pmod(F.xxhash64("fp"), lookup(2))).cast("int").alias("block")
    dealt = distinct.select("fp", F.coalesce("first", F.lit(NO_ID)).alias("first"), block, lookup(3).alias("low"), lookup(4).alias("high"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.frombuffer(bytes.fromhex("".join(rows["fp"])), np.uint8).tobytes()
        return pd.DataFrame({"block": [key[0]], "low": [key[1]], "high": [key[2]], "fps": [fps], "firsts": [rows["first"].to_numpy(np.int64).tobytes()]})

    packed = dealt.groupBy("block", "low", "high").applyInPandas(pack, "block int, low int, high int, fps binary, firsts binary")
    packed = spill(packed, "blocks")
    pairs = packed.select("block", "fps", "firsts", F.explode(F.sequence("low", "high")).alias("meets"))
    meets = {first + k: high - low + 1 for _, first, n, low, high in plan for k in range(n)}
    n_pairs = (sum(meets.values()) + len(meets)) // 2
    pairs = pairs.select(F.least("block", "meets").alias("lo"), F.greatest("block", "meets").alias("hi"), "block", "fps", "firsts").repartition(min(n_pairs, MOST_TASKS), "lo", "hi")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = {r.block: (r.fps, np.frombuffer(r.firsts, np.int64)) for r in rows.itertuples()}
        blocks = [held[k] for k in sorted(set(key)) if k in held]
        if len(blocks) < len(set(key)):  # the other block has no rows
            return pd.DataFrame({c: np.zeros(0, kind) for c, kind in (("sf", np.int64), ("s", object), ("df", np.int64), ("d", object))})
        first = np.concatenate([f for _, f in blocks])
        raw, size = b"".join(fps for fps, _ in blocks), len(blocks[0][0]) // len(blocks[0][1])
        names = lambda at: np.array([raw[k * size : k * size + size].hex() for k in at], object)
        parts = [np.frombuffer(fps, ">u8").astype(np.uint64).reshape(len(f), -1) for fps, f in blocks]
        forest = links_within(parts[0], parts[1] if len(parts) > 1 else None, radius)
        src, dst = forest[:, 0], forest[:, 1]
        return pd.DataFrame({"sf": first[src], "s": names(src), "df": first[dst], "d": names(dst)})

    links = pairs.groupBy("lo", "hi").applyInPandas(compare, "sf long, s string, df long, d string")
    return links.select(_node("sf", "s").alias("src"), _node("df", "d").alias("dst"))


def prefixes(sketches: list[bytes], frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each sketch's shingles but its most frequent ones, of which there are s // SHARED in a sketch of s.

    Two sketches that share more shingles than that share one that is left in both, whatever the order. frequent: sorted
    hashes, ordered by their counts; all others come before them, and ties go by hash.
    """
    sizes = np.array([len(x) // 8 for x in sketches], np.int64)
    owner, flat = np.repeat(np.arange(len(sketches)), sizes), np.frombuffer(b"".join(sketches), "<u8").astype(np.uint64)
    rank = np.zeros(len(flat), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        rank = np.where(frequent[at] == flat, counts[at], 0)
    order = np.lexsort((flat, rank, owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = order[place < (sizes - sizes // SHARED)[owner]]
    return owner[kept], flat[kept]


def shared_links(hashes: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest, as (node, root) rows, of the links among fingerprints of equal hashes; nodes are places in the input.

    Equal fingerprints are one node, the first of them.
    """
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # without shingles of one text
    if not len(order):
        return np.zeros((0, 2), np.int64)
    keys, rows = hashes[order], fps[order]
    _, first, node = np.unique(np.ascontiguousarray(rows).view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    parent = np.arange(len(first))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        inside = start + links_within(rows[start : start + size], None, radius)
        _fold(parent, node[inside[:, 0]], node[inside[:, 1]])
    last = np.repeat(np.where(sizes > _SMALL, 0, starts + sizes), sizes)
    for step in range(1, min(_SMALL, int(sizes.max()))):
        at = np.flatnonzero(np.arange(len(keys)) + step < last)
        at = at[np.bitwise_count(rows[at] ^ rows[at + step]).sum(axis=1, dtype=np.int32) <= radius]
        _fold(parent, node[at], node[at + step])
    nodes = np.flatnonzero(parent != np.arange(len(parent)))
    return order[np.column_stack([first[nodes], first[parent[nodes]]])]


def _frequent(distinct: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted frequent hashes of the sketches of one fingerprint in so many, their counts there, and that number. Any choice gives the same links."""
    part = max(1, n // SAMPLE_TEXTS)
    some = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).select(F.explode("sketches").alias("s")).toLocalIterator()
    hashes, counts = np.unique(np.frombuffer(b"".join(bytes(r["s"]) for r in some), "<u8").astype(np.uint64), return_counts=True)
    most = np.argsort(-counts, kind="stable")[:MOST_FREQUENT]
    most = np.sort(most[counts[most] > 3])
    return hashes[most], counts[most], part


def sharing_links(distinct: DataFrame, radius: int) -> DataFrame:
    """similar_links() among the distinct (fp, pop, first, sketches) rows whose sketches share more than one in SHARED of their shingles.

    Each sketch leaves out that many of its most frequent shingles and one that it shares is still among the rest, so all rows
    meet in buckets of shingles. A shingle of more than about BLOCK_ROWS rows is no bucket's: its rows are all compared
    with one another and those of the other such shingles by similar_links(), so that no task gathers them.
    """
    n = small_batches(distinct).count()
    frequent, counts, part = _frequent(distinct, n)
    dense = frequent[counts * part > BLOCK_ROWS]
    buckets = max(LEAST_BLOCKS, -(-n * SKETCH // BUCKET_ROWS))
    names = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("fps", pa.binary()), ("firsts", pa.binary())])

    def left(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row of the batch, hash) of the prefixes of its sketches."""
        each = batch.column("sketches").to_pylist()
        row = np.repeat(np.arange(len(each)), [len(x) for x in each])
        owner, hashes = prefixes([s for x in each for s in x], frequent, counts)
        return row[owner], hashes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list) -> pa.RecordBatch:
            hashes, fps, firsts = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            parts = [order[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True)]
            columns = [pa.array([int(bucket[p[0]]) for p in parts], pa.int32())]
            columns += [pa.array([c[p].tobytes() for p in parts], pa.binary()) for c in (hashes, fps, firsts)]
            return pa.RecordBatch.from_arrays(columns, schema=names)

        held, rows = [], 0
        for batch in batches:
            row, hashes = left(batch)
            kept = ~np.isin(hashes, dense)
            row, hashes = row[kept], hashes[kept]
            if not len(row):
                continue
            fps = np.frombuffer(bytes.fromhex("".join(batch.column("fp").to_pylist())), ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
            held.append((hashes, fps[row], batch.column("first").to_numpy(zero_copy_only=False).astype(np.int64)[row]))
            rows += len(row)
            if rows >= DEAL_ROWS:
                yield dealt(held)
                held, rows = [], 0
        if held:
            yield dealt(held)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes = left(batch)
            yield batch.take(pa.array(np.unique(row[np.isin(hashes, dense)]))).select(["fp", "pop", "first"])

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, first = np.frombuffer(b"".join(rows["hashes"]), np.uint64), np.frombuffer(b"".join(rows["firsts"]), np.int64)
        fps = np.frombuffer(b"".join(rows["fps"]), np.uint64).reshape(len(hashes), -1)
        src, dst = shared_links(hashes, fps, radius).T
        names = lambda at: np.array([fps[k].astype(">u8").tobytes().hex() for k in at], object)
        return pd.DataFrame({"sf": first[src], "s": names(src), "df": first[dst], "d": names(dst)})

    rows = distinct.select("fp", "pop", F.coalesce("first", F.lit(NO_ID)).alias("first"), "sketches")
    dealt = rows.mapInArrow(deal, "bucket int, hashes binary, fps binary, firsts binary").repartition(min(buckets, MOST_TASKS), "bucket")
    links = dealt.groupBy("bucket").applyInPandas(compare, "sf long, s string, df long, d string")
    links = links.select(_node("sf", "s").alias("src"), _node("df", "d").alias("dst"))
    if not len(dense):
        return links
    return links.unionByName(similar_links(spill(rows.mapInArrow(often, "fp string, pop int, first long"), "often-shared"), radius))


def _node(first: str, fp: str) -> Column:
    return F.struct(F.coalesce(first, F.lit(NO_ID)).alias("first"), F.col(fp).alias("fp"))


def _named(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, n, component_id, keeper) of each distinct fingerprint, written. keeper: the row that ranks first in its class, by id and then row."""
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    sketches = [F.collect_set("sketch").alias("sketches")] if "sketch" in fps.columns else []
    distinct = spill(fps.groupBy("fp", "pop").agg(F.min("id").alias("first"), F.count("*").alias("n"), best, *sketches), "distinct-fingerprints")
    roots = connected_components((sharing_links if sketches else similar_links)(distinct, radius))
    # a class's least node has its smallest id, so no row is gathered by class
    linked = roots.select(F.col("node.fp").alias("fp"), F.col("component.fp").alias("root"), F.nullif(F.col("component.first"), F.lit(NO_ID)).alias("root_id"), F.lit(True).alias("linked"))
    at = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at = spill(at.select("fp", "n", "root", "best", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("first")).alias("component_id")), "class-members")
    classes = spill(at.groupBy("root").agg(F.min("best").alias("top"), F.count("*").alias("k")), "classes")
    named = join_often(at, classes, "root", "k").select("fp", "n", "component_id", F.col("top.row").alias("keeper"))
    return spill(named, "named-fingerprints")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = 4, radius: int = 64, distinct: bool = True, sketch: int = 0) -> DataFrame:
    """(id, fp, component_id) of every row of docs; component_id is the smallest id reachable over links of at most `radius` bits.

    The defaults (distinct 5-word shingles, 256 bits, 64 apart) link every pair of a Jaccard similarity of 0.8 or more but for
    about one in 10**5: it has 39 bits expected, with a deviation of 6. 0.55 has 64 expected, unrelated texts 128. Null
    or empty texts: the zero fingerprint, linked like any other. Ties: equal fingerprints are one class. Repeated rows are
    returned as often as given; rows of null id are linked, and a class of null ids only has a null component_id, as has one
    whose smallest id is 2**63 - 1. The bits of a very long text are counted in steps, over all of it. Other columns are
    ignored, whatever their names. An empty table: no rows.

    sketch: if zero, all distinct fingerprints are compared, which grows with their square; else only those of texts whose
    sketches of so many shingles share more than one in SHARED. Of texts with fewer shingles than that the sketch is the
    whole text; SKETCH keeps a pair of longer ones of a Jaccard similarity of 0.3 but for about one in 10**5, and more of
    higher ones. Links by chance between texts without a common shingle, as a few words have to the empty text, are not made.
    """
    fps = spill(fingerprints(docs, id_col, text_col, width, words, distinct, sketch=sketch), "fingerprints")
    named = _named(fps, radius)
    return join_often(fps.select("id", "fp"), named.drop("keeper"), "fp", "n")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = 4, radius: int = 64, distinct: bool = True, sketch: int = SKETCH) -> DataFrame:
    """docs, all columns, with one row of each class: that of the smallest id, null ids last, and of its rows the first as read.

    So of repeated rows, or of copies without ids, one stays. Else as near_duplicate_classes.
    """
    number = next(f"row{'_' * k}" for k in range(len(docs.columns) + 1) if f"row{'_' * k}" not in {c.lower() for c in docs.columns})
    rows = spill(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
    fps = spill(fingerprints(rows, id_col, text_col, width, words, distinct, F.col(number), sketch), "fingerprints")
    gone = join_often(fps.select("row", "fp"), _named(fps, radius).select("fp", "n", "keeper"), "fp", "n").filter("row <> keeper").select(F.col("row").alias(number))
    gone = spill(gone, "near-copies")
    drop_folder(fps)
    maybe = likely(rows, gone, [number], "left_semi").join(gone, number, "left_anti")
    return likely(rows, gone, [number], "left_anti").unionByName(maybe).select(docs.columns)
