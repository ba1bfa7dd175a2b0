"""What the operators share: the cluster's shared folder, bounded Arrow batches, joins of hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.workers import reach_workers

#: Rows and bytes that one Python call holds at a time; a batch from Spark is cut into such slices.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
#: Rows and bytes of a batch that Spark sends to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A key is hot if it has more than one in this many rows; so there are at most as many hot keys.
HOT_KEYS = 4096
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only where none is set and no cluster is there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    That cuts the lineage: a lost executor costs the tasks that ran on it, not what led up to
    the table. The files stay until the folder is cleared, as checkpoints do, or until the
    :func:`scratch` around the call ends, unless ``keep`` is set.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwright/{uuid.uuid4().hex}/{name}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are removed at the end: write the result with ``keep`` first."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Let Spark send Python at most so many rows and bytes at a time: whole texts can be long.

    Lowers the session's settings where they are higher; results do not depend on them. Also
    lets workers import this package.
    """
    reach_workers(spark)
    for key, most, usual in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, str(1 << 30))):
        key = f"spark.sql.execution.arrow.{key}"
        text = spark.conf.get(key, usual)
        if not text.isdigit() or not 0 < int(text) <= most:
            spark.conf.set(key, str(most))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES, holder: str = "") -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most so many rows, and of about so many bytes.

    ``holder`` is the operator whose :func:`held` value may stay in the worker.
    """
    if _HELD and _HELD[0][0] != holder:
        _HELD.clear()
        give_back()
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


_HELD: list[tuple[str, Any, Any]] = []


def held(holder: str, key: Any, make: Callable[[], Any]) -> Any:
    """What a worker process keeps for the next tasks of one operator; what others left goes first."""
    if not _HELD or _HELD[0][:2] != (holder, key):
        _HELD.clear()
        give_back()
        _HELD.append((holder, key, make()))
    return _HELD[0][2]


def give_back() -> None:
    """Return free memory to the machine: worker processes live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame, by: str, how: str = "inner", least: int = 256) -> DataFrame:
    """Join on ``keys`` where one key may hold a large part of the rows of ``left``.

    ``sizes`` has the keys and the ``size`` that each has in ``left``. A key with more than one
    in 4,096 of all rows (and more than ``least``) is hot, so there are at most 4,096 hot keys,
    which is what makes broadcasting them safe. Their rows are dealt by the hash of the column
    ``by`` to as many parts as their size asks for, and the matching rows of ``right`` are
    repeated for each part: in all fewer than 4,096 rows more. Nothing is dropped. Keys of
    ``right`` are unique.
    """
    total = sizes.agg(F.sum("size").alias("total"), F.max("size").alias("most")).first()
    limit = max(least, (total.total or 0) // HOT_KEYS)
    if (total.most or 0) <= limit:
        return left.join(right, keys, how)
    hot = sizes.where(F.col("size") > limit).select(*keys, F.ceil(F.col("size") / limit).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = right.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


class IdFilter:
    """A bitmap over hashed ids that spares a shuffle of rows whose id is surely not among some.

    It is sized by their number, eight bits an id, from 4,096 bits to 16,777,216 (2 MiB, which
    bounds what is sent to tasks). It is a prefilter only: :meth:`may_hold` can be true for
    other ids, never false for one of them. Past some sixteen million ids it is mostly full
    and saves little: then the join that follows does the work, as a plain join would.
    """

    def __init__(self, ids: DataFrame, id_col: str) -> None:
        spark = ids.sparkSession
        some = ids.where(F.col(id_col).isNotNull())
        self.bits = 1 << min(24, max(12, (8 * some.count()).bit_length()))
        at = self._at(id_col)
        mask = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{id_col}`), {self.bits}) % 64 as int))").alias("mask")
        dense = spark.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        rows = some.select(F.shiftright(at, 6).alias("word"), mask).unionByName(dense).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        self.words = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"])).scalar()

    def _at(self, id_col: str) -> Column:
        return F.pmod(F.xxhash64(F.col(id_col)), F.lit(self.bits)).cast("long")

    def may_hold(self, id_col: str) -> Column:
        word = F.get(self.words, F.shiftright(self._at(id_col), 6).cast("int"))
        return word.bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{id_col}`), {self.bits}) % 64 as int))")) != 0
