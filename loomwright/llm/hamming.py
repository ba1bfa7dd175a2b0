"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments. Within distance d of a query, some segment differs in at most
d // segments bits; so looking up each segment's value at growing radii meets every near code
before a bound rises: once segments 0..j have been searched to radius r and the others to
r - 1, every code nearer than ``segments * r + j + 1`` has been seen. A query is finished when
its k-th verified distance is below that bound.

Rows fall into blocks. Each block's index is built once, and all queries, which are few beside
the rows, stream past it in batches; every block gives k rows a query, and these are merged.
A query first asks one block, by its hash, and is searched there to the bound of that block's
k-th row. To the others it brings that distance: there it is also finished once all codes up to
it have been seen.
Equal codes fold together first (only the k + 1 smallest ids of a code can ever be answers),
so a code that a third of all rows share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.shared import BATCH_ROWS, slices, small_batches, written

BITS, SEGMENTS = 64, 4
#: Rows of a block at most (about, by hash): some 12 MB of codes, ids and index.
ROW_BLOCK = 1 << 18


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Code of a vector: bit i is set if element i is above 0. Missing, null and NaN elements give 0.

    Null for a null vector. A vector with more than ``bits`` elements fails, as its code would
    leave the others out.
    """
    if bits > 64:
        raise ValueError("a code has 64 bits at most")

    def set_bit(code: Column, i: Column) -> Column:
        x = F.get(vector, i)
        return F.when(F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)), code.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(code)

    # a fold, as one expression for each bit is more than generated code can hold
    code = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), set_bit)
    wide = F.raise_error(F.concat(F.lit(f"a code has {bits} bits, the vector has more elements: "), F.size(vector).cast("string")))
    return F.when(F.size(vector) > bits, wide).when(vector.isNotNull(), code)


class SegmentIndex:
    """Sorted rows by the value of each segment of 64-bit codes."""

    def __init__(self, codes: np.ndarray, segments: int = SEGMENTS) -> None:
        if BITS % segments:
            raise ValueError("segments must divide the bits")
        self.codes, self.width = codes.view(np.uint64), BITS // segments
        self.mask = np.uint64((1 << self.width) - 1)
        self.order, self.starts = [], []
        for j in range(segments):
            value = (self.codes >> np.uint64(j * self.width)) & self.mask
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(value[order], np.arange((1 << self.width) + 1)))

    def look_up(self, j: int, queries: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, row) whose segment ``j`` differs in one of ``flips``."""
        value = ((queries >> np.uint64(j * self.width)) & self.mask)[:, None] ^ flips[None, :]
        value = value.astype(np.int64).ravel()
        first, last = self.starts[j][value], self.starts[j][value + 1]
        size = last - first
        who = np.repeat(np.repeat(np.arange(len(queries)), len(flips)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return who, self.order[j][at]


_FLIPS: dict[tuple[int, int], np.ndarray] = {}


def flips_of(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits of which ``radius`` are set."""
    if (width, radius) not in _FLIPS:
        _FLIPS[width, radius] = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.uint64)
    return _FLIPS[width, radius]


def search(index: SegmentIndex, ids: np.ndarray, queries: np.ndarray, k: int, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, id, distance)`` of the k nearest rows of each query, by distance, then id.

    Rows farther than a query's limit need not be found; those up to it always are.
    """
    segments = len(index.order)
    queries = queries.view(np.uint64)
    active = np.arange(len(queries))
    who, what, far = (np.empty(0, np.int64) for _ in range(3))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for radius in range(index.width + 1):
        flips = flips_of(index.width, radius)
        for j in range(segments):
            for part in range(0, len(flips), 2048):
                n, row = index.look_up(j, queries[active], flips[part : part + 2048])
                owner = active[n]
                dist = np.bitwise_count(index.codes[row] ^ queries[owner]).astype(np.int64)
                who, what, far = (np.concatenate(x) for x in ((who, owner), (what, row), (far, dist)))
                # the k best of each query so far; a row met twice counts once
                order = np.lexsort((ids[what], far, who))
                who, what, far = who[order], what[order], far[order]
                fresh = np.ones(len(who), bool)
                fresh[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
                who, what, far = who[fresh], what[fresh], far[fresh]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                keep = rank < k
                who, what, far, rank = who[keep], what[keep], far[keep], rank[keep]
            bound = segments * radius + j + 1
            worst = np.full(len(queries), np.iinfo(np.int64).max)
            last = rank == min(k, len(ids)) - 1
            worst[who[last]] = far[last]
            reached = worst[active] < bound
            if limits is not None:
                reached |= limits[active] < bound
            settled = active[reached]
            if len(settled):
                out = np.isin(who, settled)
                done.append((who[out], what[out], far[out]))
                who, what, far = who[~out], what[~out], far[~out]
                active = np.setdiff1d(active, settled, assume_unique=True)
            if not len(active):
                who, what, far = (np.concatenate(x) for x in zip(*done, strict=True))
                return who, ids[what], far
    raise AssertionError("at full radius every row has been seen")


_SCHEMA = pa.schema([("query_code", pa.int64()), ("id", pa.int64()), ("distance", pa.int64())])


def _stream(k: int, segments: int):
    """Over batches ordered by block, each block's rows before the queries: the answers to the queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, index, ids = -1, [], None, None
        for batch in slices(batches, BATCH_ROWS):
            at, asks, named, codes, far = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(5))
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if at[low] != block:
                    block, rows, index = at[low], [], None
                if not asks[low]:
                    rows.append((named[low:high], codes[low:high]))
                    continue
                if not rows:
                    continue
                if index is None:
                    ids, index = np.concatenate([x for x, _ in rows]), SegmentIndex(np.concatenate([x for _, x in rows]), segments)
                # a few queries at a time, so that what one step meets stays small
                step = max(1, min(64, (1 << 24) // len(ids)))
                for x in range(low, high, step):
                    asked, limits = codes[x : min(x + step, high)], far[x : min(x + step, high)]
                    who, what, distance = search(index, ids, asked, k, limits)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (asked[who], what, distance)], schema=_SCHEMA)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", code_col: str = "code", segments: int = SEGMENTS, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, neighbor_id, distance, rank``: the k nearest other rows of each query row.

    Order is by distance, then id; a query does not find its own id. Rows with a null id or
    code are neither found nor asked for; repeated rows count once; one id with several codes
    counts with each of them, its nearest first. Fewer than k rows give fewer answers; no rows
    or queries give none; other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).dropna().distinct()
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(code_col).cast("long").alias("query_code")).dropna().distinct()
    low = Window.partitionBy("code").orderBy("id")
    own = written(own.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k + 1).drop("_n"), "codes")
    codes = asked.select(F.col("query_code").alias("code")).distinct()
    # as many blocks as their size asks for; of few rows, as many as there are cores
    many = own.count()
    blocks = max(1, -(-many // row_block), min(spark.sparkContext.defaultParallelism, many // 8192))
    block = F.pmod(F.xxhash64("code", "id"), F.lit(blocks)).cast("int")
    left = own.select(block.alias("block"), F.lit(False).alias("asks"), "id", "code", F.lit(0).cast("long").alias("far"))

    def ask(asking: DataFrame) -> DataFrame:
        """Answers of the blocks to ``asking(block, code, far)``."""
        right = asking.select("block", F.lit(True).alias("asks"), F.lit(0).cast("long").alias("id"), "code", "far")
        dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "asks")
        return dealt.mapInArrow(_stream(k + 1, segments), "query_code long, id long, distance long")

    best = Window.partitionBy("query_code").orderBy("distance", "id")
    # each query first asks one block, so all blocks have about as many of them
    home = F.pmod(F.xxhash64("code", F.lit(blocks)), F.lit(blocks)).cast("int")
    found = ask(codes.select(home.alias("block"), "code", F.lit(BITS).cast("long").alias("far")))
    if blocks > 1:
        found = written(found, "first")
        # as far as that block's last answer, if it has that many
        kth = found.groupBy("query_code").agg(F.when(F.count("*") > k, F.max("distance")).otherwise(F.lit(BITS)).alias("far"))
        asking = codes.join(kth.withColumnRenamed("query_code", "code"), "code", "left").select("code", F.coalesce("far", F.lit(BITS)).cast("long").alias("far"), home.alias("home"))
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: x != F.col("home"))
        found = found.unionByName(ask(asking.select(F.explode(others).alias("block"), "code", "far")))
    found = written(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"), "found")
    answers = asked.join(found, "query_code").where("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    mine = Window.partitionBy("query_id").orderBy("distance", "id")
    return answers.withColumn("rank", F.row_number().over(mine).cast("long")).where(F.col("rank") <= k).select("query_id", F.col("id").alias("neighbor_id"), "distance", "rank")
