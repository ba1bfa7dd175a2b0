"""Token counts from pre-token frequencies: no ids are made for any document.

A token never crosses a pre-token, so a document's count is the sum over its pre-tokens of
frequency times pieces. Pieces are counted once for each distinct pre-token. The pre-tokens
found most often in a bounded sample (``head_size`` of them at most, so safe to broadcast)
are looked up where the text is read; all others, whatever their number, go as (document,
pre-token, frequency) through an ordinary join with their counts. The split changes where a
pre-token is counted, never the sum.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm.pretokens import splitter
from loomwright.llm.shared import held, slices, small_batches, written

HEAD_SIZE, HEAD_DOCS = 200_000, 4_000


class _Splitter:
    """Pre-tokens of a text and the number of special tokens in it."""

    def __init__(self, pattern: str, specials: list[str]) -> None:
        self.pieces = splitter(pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.pieces(text), 0
        parts = self.special.split(text)
        return [p for x in parts for p in self.pieces(x)], len(parts) - 1


def special_strings(tokenizer_json: str) -> list[str]:
    """Strings that the library takes for special tokens wherever they stand in a text."""
    return [t.content for t in Tokenizer.from_str(tokenizer_json).get_added_tokens_decoder().values() if t.special]


def _frequencies(pattern: str, specials: list[str], shared, longest: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, head = _Splitter(pattern, specials), shared.value if shared else {}
        get = head.get
        for part in slices(batches):
            base, tails, counts = [], [], []
            for text in part.column(3).to_pylist():
                pieces, total = split(text) if text else ((), 0)
                found = list(map(get, pieces))
                if None in found:
                    tail = Counter(p for p, n in zip(pieces, found, strict=True) if n is None)
                    found = [n for n in found if n is not None]
                else:
                    tail = Counter()
                base.append(total + sum(found))
                tails.append(list(tail))
                counts.append(list(tail.values()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(base, pa.int64()), pa.array(tails, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_bytes", "base", "tail", "freq"],
            )

    return run


_SCHEMA = "doc_id long, text_hash long, n_bytes long, base long, tail array<string>, freq array<long>"


def _load(tokenizer_json: str) -> Tokenizer:
    """One tokenizer a process, without threads of its own: a task has one core."""
    def make() -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_str(tokenizer_json)
        tok.no_truncation()
        tok.no_padding()
        return tok

    return held("token_counts", zlib.crc32(tokenizer_json.encode()), make)


def _pieces(tokenizer_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(tokenizer_json)
        for part in slices(batches, 2048, holder="token_counts"):
            got = tok.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.ids) for x in got], pa.int64())], names=["piece", "n"])

    return run


def count_tokens(docs: DataFrame, tokenizer_json: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD_SIZE, head_docs: int = HEAD_DOCS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row, as the tokenizer's library counts.

    ``tokenizer_json`` is the content of the tokenizer's file; ``pattern`` its pre-token
    pattern. No begin, end or added tokens; special strings in texts count as the library
    takes them by default. A null text counts as empty. Repeated rows give repeated rows, and
    rows that share an id each get their own text's count; other columns are not read; no rows
    give no rows. ``head_docs`` documents at most (about; by a hash of the id) are sampled for
    the table of frequent pre-tokens.
    """
    spark, specials = docs.sparkSession, special_strings(tokenizer_json)
    small_batches(spark)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))

    many = docs.count()
    share = min(1.0, head_docs / max(1, many))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    seen = sample.mapInArrow(_frequencies(pattern, specials, None), _SCHEMA).select(F.explode(F.arrays_zip("tail", "freq")).alias("x"))
    seen = seen.where(F.length("x.tail") <= 64).groupBy(F.col("x.tail").alias("piece")).agg(F.sum("x.freq").alias("freq"))
    top = [r.piece for r in seen.orderBy(F.desc("freq"), "piece").limit(head_size).collect()]
    tok = _load(tokenizer_json)
    head = {p: len(e.ids) for k in range(0, len(top), 10_000) for p, e in zip(top[k : k + 10_000], tok.encode_batch_fast(top[k : k + 10_000], add_special_tokens=False), strict=True)}
    shared = spark.sparkContext.broadcast(head)

    table = written(rows.mapInArrow(_frequencies(pattern, specials, shared), _SCHEMA), "frequencies")
    tail = table.select("doc_id", "text_hash", F.explode(F.arrays_zip("tail", "freq")).alias("x")).select("doc_id", "text_hash", F.col("x.tail").alias("piece"), F.col("x.freq").alias("freq"))
    counts = tail.select("piece").distinct().mapInArrow(_pieces(tokenizer_json), "piece string, n long")
    # before the shuffle a row of the tail stands for one document, so only sums travel on
    sums = tail.join(counts, "piece").groupBy("doc_id", "text_hash").agg(F.sum(F.col("freq") * F.col("n")).alias("more"))
    whole = table.select("doc_id", "text_hash", "n_bytes", "base", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("more"))
    both = whole.unionByName(sums.select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("copies"), "more"))
    # repeated rows of one text meet here: each has the same base, and the tail's sum holds it once a row
    doc = both.groupBy("doc_id", "text_hash").agg(F.max("n_bytes").alias("n_bytes"), F.max("base").alias("base"), F.sum("copies").alias("copies"), F.sum("more").alias("more"))
    one = doc.withColumn("n_tokens", F.col("base") + F.expr("more div copies"))
    return one.select("doc_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")
