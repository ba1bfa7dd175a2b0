"""Vector code compression: product codes over integer components, exact to the last unit.

Components become integers ``floor(256 x)``; vectors are cut into equal parts; each part
position has a small codebook, trained by rounds of assigning and averaging. The nearest entry
is found in two steps. A float32 matrix product screens all entries: with the standard bound on
the rounding error of a dot product, in whatever order it is summed, each squared distance lies
in an interval around what was computed. Every entry whose interval reaches down to the least
upper end is then evaluated in 64-bit integers, and equal distances go to the lower index. So
the answer does not depend on the matrix library, and few entries are evaluated twice.

Codebooks have 64 entries of a vector's width, whatever the rows' number: they are what the
driver holds and tasks are sent. A round sends one row for each entry and task back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomwright.llm.shared import slices, small_batches, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components below this are exact as float32, and squared distances of any width up to 8,191 as int64.
LIMIT = 1 << 24


def integer_vector(vector: Column, parts: int = PARTS) -> Column:
    """``floor(256 x)`` of each component; null if the vector is null or holds a null or non-finite one.

    A component out of exact reach, or a width that ``parts`` does not divide, is an error.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = F.exists(vector, lambda x: F.abs(x.cast("double") * SCALE) >= LIMIT)
    wrong = (F.size(vector) % parts != 0) | (F.size(vector) >= 8192)
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    told = F.when(wrong, F.raise_error(F.concat(F.lit("no such width can be cut into equal parts: "), F.size(vector).cast("string"))))
    told = told.when(far, F.raise_error(F.lit(f"a component is {LIMIT // SCALE} or more"))).otherwise(ints)
    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), told)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index; both int64 and below :data:`LIMIT`."""
    terms = rows.shape[1] + 1
    gamma = terms * 2.0**-24 / (1 - terms * 2.0**-24)
    dots = (rows.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    own, squares = (rows * rows).sum(1).astype(np.float64), (book * book).sum(1).astype(np.float64)
    # the sum of the products' sizes is at most the product of the lengths
    off = gamma * np.sqrt(own)[:, None] * np.sqrt(squares)[None, :]
    score = squares[None, :] - 2 * dots
    # the second term covers what the doubles here are rounded by
    error = 2 * off + (squares[None, :] + 2 * np.abs(dots) + 2 * off + 1) * 2.0**-45
    close = score - error <= (score + error).min(1, initial=np.inf)[:, None]
    who, which = np.nonzero(close)
    apart = rows[who] - book[which]
    distance = (apart * apart).sum(1)
    starts = np.searchsorted(who, np.arange(len(rows)))
    least = np.minimum.reduceat(distance, starts)
    return np.minimum.reduceat(np.where(distance == least[who], which, len(book)), starts), least


def _matrix(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    flat = column.flatten()
    if len(flat) != len(column) * shape[0] * shape[1]:
        raise ValueError("vectors of different widths cannot share a codebook")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def _sums(books: np.ndarray):
    """Over batches of vectors: for each entry of each part that a task used, the number and sum of its parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in slices(batches, 1000):
            rows = _matrix(batch.column(0), (parts, width))
            for p in range(parts):
                at, _ = nearest(rows[:, p], books[p])
                np.add.at(count[p], at, 1)
                np.add.at(total[p], at, rows[:, p])
        part, entry = np.nonzero(count)
        columns = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return run


def train(vectors: DataFrame, seeds: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(parts, entries, width of a part)`` from ``vector array<long>``; entries start as the seeds' parts.

    Each round averages what an entry is nearest to, componentwise and rounded down; an entry
    that nothing is nearest to stays as it is.
    """
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    width = books.shape[2]
    for _ in range(rounds if books.size else 0):
        summed = vectors.select("vector").mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
        # one row for each part and entry, of which there are 1,024
        for row in summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect():
            books[row.part, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return books


def seeds_of(vectors: DataFrame, id_col: str, entries: int = ENTRIES) -> np.ndarray:
    """Vectors of the smallest ids, ascending; of several rows of one id the least vector counts, null ids are left out."""
    ids = [r[0] for r in vectors.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(id_col).limit(entries).collect()]
    if not ids:
        return np.zeros((0, 0), np.int64)
    found = vectors.where(F.col(id_col).isin(ids)).groupBy(id_col).agg(F.min("vector").alias("vector")).orderBy(id_col).collect()
    if len({len(r.vector) for r in found}) > 1:
        raise ValueError("vectors of different widths cannot share a codebook")
    return np.array([r.vector for r in found], np.int64)


def books_sha256(books: np.ndarray) -> str:
    """Hex digest of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coder(books: np.ndarray, n_kept: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            rows = _matrix(batch.column(n_kept), (parts, width))
            code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                code[:, p], off = nearest(rows[:, p], books[p])
                error += off
            columns = [*batch.columns[:n_kept], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error, label_error)`` of every kept row under the names given, and the codebooks.

    Rows whose vector is null, or holds a null or non-finite component, are dropped; a repeated
    row is kept as often as it comes; a row without an id gets a code, but seeds no entry; if no
    row has an id, the codebooks are empty, codes are empty strings and errors 0. ``label_error``
    sums the errors of equal labels, nulls together. Vectors must share one width, a multiple of
    ``parts`` (else an error). No rows give no rows; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index takes two hex digits")
    spark = rows.sparkSession
    small_batches(spark)
    label = F.col(label_col)
    kept = rows.select(F.col(id_col).alias("id"), label.alias("label"), integer_vector(F.col(vector_col), parts).alias("vector")).where("vector is not null")
    kept = written(kept, "integers")
    seeds = seeds_of(kept, "id", entries)
    books = train(kept, seeds, parts, rounds) if seeds.size else np.zeros((parts, 0, 0), np.int64)
    named = StructType([*kept.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    if books.size:
        coded = written(kept.mapInArrow(_coder(books, 2), named), "coded")
    else:
        coded = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    # nulls are a label of their own
    keys = {"_none": F.col("label").isNull(), "_key": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    coded = coded.withColumns(keys)
    sums = coded.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("size"))
    out = spread_join(coded, sums.drop("size"), list(keys), sums.select(*keys, "size"), "code")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books
