"""Files with names of their own, one a row, written and read by tasks: Markdown nodes, queues, sidecars, texts.

Spark's file writers name files themselves; a corpus of notes wants ``<id>.md``. Every task writes
into a hidden folder of its attempt; only when all have succeeded are the files of the attempts
that count moved to their names, by tasks again. A failed task leaves nothing behind; a name that
comes twice fails the write. Neither names nor lists of files go through the driver.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.folders import written
from loomwright.functions.joins import grown
from loomwright.functions.workers import bounded_batches, reach_workers

#: Moves of a task at a time: each is a call that waits for the store.
MOVERS = 4
#: Tasks at most that list a folder or read its files, or four for each core if those are more.
READERS = 64
#: Rows and bytes of a batch of files that are read.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a folder in it; plain paths are local, others by their scheme."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), posixpath.abspath(path)


def checked(name: str | None) -> str:
    """A name that stays inside the folder and that readers see."""
    if not name or name.startswith("/") or any(p in ("", ".", "..") or p.startswith((".", "_")) for p in name.split("/")):
        raise ValueError(f"not a name for a file: {name!r}")
    return name


def _entries(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Name of each entry of a folder, and whether it is a file; a local folder is never held as a list."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((e.name, e.is_file()) for e in found)
    else:
        yield from ((info.base_name, info.type == pafs.FileType.File) for info in fs.get_file_info(pafs.FileSelector(folder)))


def _tasks(spark: SparkSession) -> int:
    return max(READERS, 4 * spark.sparkContext.defaultParallelism)


def _share(fs: pafs.FileSystem, folder: str, task: int, tasks: int) -> Iterator[tuple[str, bool]]:
    """The entries of a folder that fall to one of its tasks: each lists the folder, none is told what it holds."""
    return ((name, is_file) for name, is_file in _entries(fs, folder) if zlib.crc32(name.encode("utf-8", "surrogateescape")) % tasks == task)


def read_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, content`` of the files in a folder that end with ``suffix``, hidden ones left out; empty files have a row too.

    Tasks list the folder and read their share. Spark's reader of binary files, which lists them
    in the driver and has no row for an empty one, takes what is no folder or file that workers
    reach: patterns, and schemes that only Spark knows.
    """
    reach_workers(spark)
    try:
        fs, root = open_folder(path)
        kind = fs.get_file_info(root).type
    except (pa.ArrowException, OSError):
        kind = pafs.FileType.NotFound
    if kind not in (pafs.FileType.File, pafs.FileType.Directory):
        return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")
    tasks, one = (_tasks(spark), None) if kind == pafs.FileType.Directory else (1, posixpath.basename(root))
    folder = root if one is None else posixpath.dirname(root)
    shown = f"file:{folder}" if isinstance(fs, pafs.LocalFileSystem) else path.rstrip("/") if one is None else posixpath.dirname(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(path)
        paths, contents, held = [], [], 0
        for task in (t for b in batches for t in b.column(0).to_pylist()):
            for name, is_file in [(one, True)] if one is not None else _share(fs, folder, task, tasks):
                if not is_file or name.startswith((".", "_")) or not name.endswith(suffix):
                    continue
                with fs.open_input_stream(f"{folder}/{name}") as file:
                    contents.append(file.read())
                paths.append(f"{shown}/{name}")
                held += len(contents[-1])
                if len(paths) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "path string, content binary")


def _old_files(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """``name`` of every file below a folder, but for those that are being written."""
    tasks = _tasks(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for task in (t for b in batches for t in b.column(0).to_pylist()):
            for name, is_file in _share(fs, root, task, tasks):
                below = [] if is_file or name == stage else fs.get_file_info(pafs.FileSelector(f"{root}/{name}", recursive=True))
                names = [name] if is_file else [info.path[len(root) + 1 :] for info in below if info.type == pafs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "name string")


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write ``files(name, text)``; a name may have folders. ``overwrite`` removes what else the folder holds."""
    spark, stage = files.sparkSession, f".writing-{uuid.uuid4().hex}"
    bounded_batches(spark)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        own = f"{root}/{stage}/{uuid.uuid4().hex}"
        made = set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{own}/{checked(name)}"
                parent = posixpath.dirname(place)
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(place) as out:
                    out.write((text or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([own] * batch.num_rows, pa.string()), batch.column(0)], names=["own", "name"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        made = set()

        def one(own: str, name: str) -> None:
            try:
                fs.move(f"{own}/{name}", f"{root}/{name}")
            except FileNotFoundError:
                # an attempt before this one may have moved it
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise

        with ThreadPoolExecutor(MOVERS) as pool:
            for batch in batches:
                owns, names = (batch.column(k).to_pylist() for k in range(2))
                for parent in {posixpath.dirname(f"{root}/{n}") for n in names} - made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                # a list, as an error shows only when a result is taken
                list(pool.map(one, owns, names))
                yield pa.RecordBatch.from_arrays([pa.array([len(names)])], names=["n"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs.delete_file(f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    fs, root = open_folder(folder)
    try:
        # Spark's own committer keeps the rows of the attempts that count
        staged = written(files.select("name", "text").mapInArrow(put, "own string, name string"), "staged")
        if not staged.groupBy("name").count().where("count > 1").isEmpty():
            raise ValueError("a name comes twice")
        if overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            _old_files(spark, folder, stage).join(grown(staged.select("name")), "name", "left_anti").mapInArrow(remove, "n long").agg(F.sum("n")).collect()
        staged.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        if fs.get_file_info(f"{root}/{stage}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{stage}")
