"""Exact nearest vectors through a pivot index: cells that cannot hold an answer are not visited.

Some vectors are pivots. Each row goes to the cell of the pivot at the least angle, and a cell
keeps its number of rows, its least and greatest angle to the pivot, and its least and greatest
length. By the triangle inequality of angles these bound the dot product of a query with any row
of a cell. A query first visits the cells with the highest bounds until they hold k rows, then
those whose bound reaches its k-th best so far. Neighbouring cells form blocks of rows, and
queries are dealt to blocks too: a query is sent once to each block of which it visits a cell, a
row once for each block of queries, so what is sent grows with the number of blocks, not of cells.
A block's answers are a query's k nearest there, less what its k-th best so far excludes.

How much is pruned depends on the vectors: much where they come in clusters, as embeddings of
texts do, or where only high similarities are asked for (``least``); nothing where directions
are spread evenly over many dimensions, as then no bound of this kind tells cells apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.folders import written
from loomwright.functions.joins import grown
from loomwright.functions.workers import bounded_batches, reach_workers

#: Pivots at most: with their vectors and bounds they are what the driver holds and tasks are sent.
MOST_PIVOTS = 1024
#: Rows of the sample that pivots are chosen from, for each pivot.
SAMPLE = 8
#: Rows and bytes of a block of rows or queries, two of which one task compares; larger cells have several parts.
PART_ROWS, PART_BYTES = 65536, 32 << 20
#: Rows of a block at least that are split to have work for more tasks, and tasks that there should be.
FEW_ROWS, LEAST_BLOCKS = 2048, 8
#: Queries and rows that are compared at a time.
TILE = (256, 4096)
#: What angles and dot products may be off by.
SLACK = 1e-6
_ANSWER = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles between rows and unit pivots, and the rows' lengths."""
    lengths = np.linalg.norm(vectors, axis=1)
    return np.arccos(np.clip(vectors @ pivots.T / np.maximum(lengths, 1e-300)[:, None], -1.0, 1.0)), lengths


def _spread(units: np.ndarray, many: int) -> np.ndarray:
    """So many of some unit vectors, each the farthest from those before it; fewer if the rest repeat them."""
    taken, near = [0], units @ units[0]
    while len(taken) < many:
        far = int(near.argmin())
        if near[far] > 1.0 - 1e-12:
            break
        taken.append(far)
        near = np.maximum(near, units @ units[far])
    return units[taken]


def _bounds(angles: np.ndarray, lengths: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Greatest dot product that each query can have with a row of each cell (``least, greatest angle, least, greatest length, rows``)."""
    nearest = np.maximum(0.0, np.maximum(angles - cells[:, 1], cells[:, 0] - angles) - SLACK)
    cos = np.cos(nearest)
    top = lengths[:, None] * np.where(cos > 0, cells[:, 3], cells[:, 2]) * cos
    return np.where(cells[:, 4] > 0, top + SLACK * np.maximum(1.0, np.abs(top)), -np.inf)


def _first(bounds: np.ndarray, rows: np.ndarray, need: int) -> np.ndarray:
    """Which cells a query visits first: those with the highest bounds that together hold ``need`` rows."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    visits = np.zeros(bounds.shape, bool)
    np.put_along_axis(visits, order, before < need, axis=1)
    return visits & np.isfinite(bounds)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class PivotIndex:
    """``index(id, vector)`` dealt to cells; rows without a vector are left out. Written to the shared folder."""

    def __init__(self, index: DataFrame, pivots: int | None = None) -> None:
        spark = index.sparkSession
        reach_workers(spark)
        rows = index.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        many = pivots or min(MOST_PIVOTS, max(1, math.isqrt(rows.count())))
        # a sample by hash, the same on every run
        some = np.array([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * many).collect()], dtype=float)
        chosen = self.pivots = _spread(some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300), many) if len(some) else np.zeros((0, 1))
        units = self.pivots

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                angles, lengths = _angles(_matrix(batch.column(1)), units)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), pa.array(lengths)], names=["id", "vector", "cell", "angle", "length"])

        dealt = rows.mapInArrow(deal, "id long, vector array<double>, cell int, angle double, length double") if len(chosen) else rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("length"))
        self.rows = written(dealt, "cells")
        self.cells = np.zeros((len(self.pivots), 5))
        for r in self.rows.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.min("length"), F.max("length"), F.count("*")).collect():
            self.cells[r[0]] = r[1:]

    def _asked(self, queries: DataFrame, best: DataFrame | None) -> DataFrame:
        asked = queries.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        return asked if best is None else asked.join(grown(best.select("id", "kth")), "id", "left")

    def _wanted(self, k: int, least: float | None):
        """Function of a batch ``(id, vector)`` or ``(id, vector, kth)``: which cells each row visits, and the least similarity that counts."""
        pivots, cells, floor = self.pivots, self.cells, -np.inf if least is None else least

        def wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            bounds = _bounds(*_angles(_matrix(batch.column(1)), pivots), cells)
            first = _first(bounds, cells[:, 4], k + 1)
            if batch.num_columns == 2:
                return first & (bounds >= floor), np.full(len(bounds), floor)
            kth = np.maximum(batch.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False), floor)
            return ~first & (bounds >= kth[:, None]) & np.isfinite(bounds), kth

        return wanted

    def visits(self, queries: DataFrame, k: int, least: float | None = None, best: DataFrame | None = None) -> DataFrame:
        """``id, vector, cell`` for each cell that a query ``(id, vector)`` visits: in the first round, or, given ``best(id, kth)``, after it."""
        asked, wanted = self._asked(queries, best), self._wanted(k, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                who, cell = np.nonzero(wanted(batch)[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

        return asked.mapInArrow(run, "id long, vector array<double>, cell int") if len(self.pivots) else asked.select("id", "vector", F.lit(0).alias("cell")).limit(0)

    def _blocks(self) -> tuple[np.ndarray, np.ndarray, int]:
        """First block and number of blocks of each cell, and the rows of a block."""
        rows = self.cells[:, 4]
        most = int(max(1, min(PART_ROWS, PART_BYTES // (8 * self.pivots.shape[1]), max(FEW_ROWS, rows.sum() // LEAST_BLOCKS))))
        first, parts, at, held = np.zeros(len(rows), int), np.ones(len(rows), int), 0, 0
        for c, n in enumerate(rows):
            if held and held + n > most:
                at, held = at + 1, 0
            first[c], parts[c] = at, max(1, math.ceil(n / most))
            # a cell of several parts fills blocks of its own
            at, held = (at + int(parts[c]), 0) if parts[c] > 1 else (at, held + n)
        return first, parts, most

    def answers(self, queries: DataFrame, k: int, digits: int, least: float | None = None, best: DataFrame | None = None) -> DataFrame:
        """``id, other, similarity``: of each block of rows the k nearest in the cells that a query visits, its own id left out."""
        spark = queries.sparkSession
        asked = self._asked(queries, best)
        if not len(self.pivots):
            return asked.select("id", F.lit(0).cast("long").alias("other"), F.lit(0.0).alias("similarity")).limit(0)
        wanted, (first, parts, most) = self._wanted(k, least), self._blocks()
        of_block = np.zeros((len(first), int((first + parts).max())), np.float32)
        for c, (at, n) in enumerate(zip(first, parts, strict=True)):
            of_block[c, at : at + n] = 1
        groups = max(1, math.ceil(asked.count() / most))
        slack = 10.0**-digits

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                visits, floor = wanted(batch)
                who, block = np.nonzero(visits.astype(np.float32) @ of_block)
                packed, rows = np.packbits(visits, axis=1), pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(floor[who]), pa.array([packed[i].tobytes() for i in who], pa.binary())], names=["block", "fid", "fv", "floor", "cells"])

        def compare(_key, held: pa.Table, asked: pa.Table) -> pa.Table:
            if not held.num_rows or not asked.num_rows:
                return _ANSWER.empty_table()
            held = held.sort_by("cell")
            ids, vectors, cell = held["id"].to_numpy(), _matrix(held["vector"].combine_chunks()), held["cell"].to_numpy()
            here, place = np.unique(cell, return_inverse=True)
            who, wants, floor = asked["fid"].to_numpy(), _matrix(asked["fv"].combine_chunks()), asked["floor"].to_numpy()
            visits = np.unpackbits(np.frombuffer(b"".join(asked["cells"].to_pylist()), np.uint8).reshape(len(who), -1), axis=1)[:, here].astype(bool)
            # those that visit the same cells come together
            order, out = np.lexsort(visits.T[::-1]), []
            for some in (order[at : at + TILE[0]] for at in range(0, len(order), TILE[0])):
                seen, q = visits[some], wants[some]
                columns = np.flatnonzero(seen.any(axis=0)[place])
                least_now, found = floor[some] - slack, []
                for at in range(0, len(columns), TILE[1]):
                    tile = columns[at : at + TILE[1]]
                    scores = q @ vectors[tile].T
                    allowed = seen[:, place[tile]]
                    if not allowed.all():
                        scores[~allowed] = -np.inf
                    # its own id may be among the first k + 1
                    near = scores >= least_now[:, None]
                    if len(tile) > k + 1 and near.sum() > 4 * (k + 1) * len(some):
                        least_now = np.maximum(least_now, np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] - 2 * slack)
                        near = scores >= least_now[:, None]
                    i, j = np.nonzero(near & np.isfinite(scores))
                    found.append((i, ids[tile[j]], np.round(scores[i, j], digits)))
                if not found:
                    continue
                i, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
                own = other == who[some][i]
                i, other, score = i[~own], other[~own], score[~own]
                best_first = np.lexsort((other, -score, i))
                i, other, score = i[best_first], other[best_first], score[best_first]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((who[some][i[kept]], other[kept], score[kept]))
            if not out:
                return _ANSWER.empty_table()
            return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), _ANSWER.types, strict=True)], schema=_ANSWER)

        bounded_batches(spark)
        group = lambda name: F.pmod(F.xxhash64(name), F.lit(groups)).cast("int").alias("group")
        place = F.broadcast(spark.createDataFrame([(c, int(a), int(n)) for c, (a, n) in enumerate(zip(first, parts, strict=True))], "cell int, first int, parts int"))
        rows = self.rows.select("cell", "id", "vector").join(place, "cell")
        left = rows.select((F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "cell", "id", "vector")
        right = asked.mapInArrow(send, "block int, fid long, fv array<double>, floor double, cells binary").select("*", group("fid"))
        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(compare, "id long, other long, similarity double")

    def nearest(self, queries: DataFrame, k: int, digits: int = 6, least: float | None = None) -> DataFrame:
        """``id, other, similarity, rank``: the k nearest of each query, ties to the smaller id; with ``least``, only those that similar."""
        order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
        rounding = 10.0**-digits
        floor = None if least is None else least - rounding
        found = written(self.answers(queries, k, digits, floor), "first")
        # a query that has k answers needs what is as near as the last of them
        kth = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("id", (F.col("similarity") - rounding).alias("kth"))
        more = self.answers(queries, k, digits, floor, kth)
        ranked = found.unionByName(more).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        return ranked if least is None else ranked.where(F.col("similarity") >= least)
