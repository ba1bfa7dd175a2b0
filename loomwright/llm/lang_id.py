"""Language identification by word-first backoff.

A word that training saw is scored by its log frequency in each language. An unseen word falls
back to its character n-grams, longest first: the first order of which any n-gram was seen
scores the word by the mean over its seen n-grams. Words are runs of letters, lower-cased.
Units (words and n-grams) are known by 64-bit hashes, so that many words are scored at once
with arrays, and the model holds a number for each unit and language, no strings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.neardup_kernel import mix, span_hashes
from loomwright.llm.shared import slices, small_batches, written

#: Training documents at most; they bound the words and n-grams of the model, all of which count.
TRAIN_DOCS = 10_000
ORDERS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: An equal pattern for texts of ASCII and Latin letters, which Python's own engine reads faster.
_OTHER = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
_LATIN = re.compile(r"[a-zß-öø-ÿ]+")
#: Words whose rows a task keeps.
_CACHE = 100_000
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if _OTHER.search(text) else _LATIN.findall(low)


def units_of(words: list[str], orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order ``(order, word number, unit)``: a unit is a hash with the order in its upper bits.

    Order 0 is the word itself. From order 2 on a word's ends are marked before it is cut.
    """
    marked = np.frombuffer("".join([f"_{w}_" for w in words]).encode("utf-32-le"), "<u4").astype(_U)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    for order in orders:
        if not order:
            who, units = np.arange(len(words)), span_hashes(marked, starts, starts + sizes)
        else:
            skip = int(order == 1)
            many = np.maximum(sizes - 2 * skip - order + 1, 0)
            who = np.repeat(np.arange(len(words)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + (starts + skip)[who]
            units = np.zeros(len(at), _U)
            for k in range(order):
                units = units * _U(0x9E3779B97F4A7C15) + marked[at + k] + _U(1)
            units = mix(units)
        yield order, who, (units >> _U(3)) | (_U(order) << _U(61))


@dataclass
class Model:
    """Log frequencies by language of units: ``logs`` has a row for each of the sorted ``units``.

    ``least`` has the log frequency that an order's units have in a language without them.
    """

    langs: list[str]
    units: np.ndarray
    logs: np.ndarray
    least: np.ndarray

    def find(self, units: np.ndarray) -> np.ndarray:
        """Row of each unit, -1 for one that training did not see."""
        if not len(self.units):
            return np.full(len(units), -1)
        at = np.minimum(np.searchsorted(self.units, units), len(self.units) - 1)
        return np.where(self.units[at] == units, at, -1)

    def seen_in(self, rows: np.ndarray) -> np.ndarray:
        """Whether training saw these units in each language."""
        return self.logs[rows] > self.least[(self.units[rows] >> _U(61)).astype(np.int64)] + 0.5

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies by language for each word; zeros where nothing of it was seen."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        left = np.arange(len(words))
        for order in (0, *ORDERS):
            if not len(left):
                break
            (_, who, units), = units_of([words[k] for k in left], (order,))
            rows = self.find(units)
            who, rows = who[rows >= 0], rows[rows >= 0]
            many = np.bincount(who, minlength=len(left))
            hit = many > 0
            for k in range(len(self.langs)):
                out[left[hit], k] = np.bincount(who, self.logs[rows, k], len(left))[hit] / many[hit]
            left = left[~hit]
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """For each word, how many of its longest n-grams training saw in each language, and how many there are."""
        out = np.zeros((len(words), len(self.langs) + 1), np.float32)
        sizes = np.minimum(np.fromiter(map(len, words), np.int64, len(words)) + 2, ORDERS[0])
        for order in np.unique(sizes).tolist():
            here = np.flatnonzero(sizes == order)
            (_, who, units), = units_of([words[k] for k in here], (order,))
            rows = self.find(units)
            out[here, -1] = np.bincount(who, minlength=len(here))
            seen = self.seen_in(rows[rows >= 0])
            for k in range(len(self.langs)):
                out[here, k] = np.bincount(who[rows >= 0], seen[:, k], len(here))
        return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        seen: Counter = Counter()
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            seen.update((lang, w) for w in words_of(text))
        if seen:
            langs, names = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of units from counts of distinct words."""
    for part in slices(batches, 1 << 14):
        langs, counts = np.array(part.column(0).to_pylist(), dtype=object), part.column(2).to_numpy()
        words = part.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            here = np.flatnonzero(langs == lang)
            for _, who, units in units_of([words[k] for k in here], (0, *ORDERS)):
                some, at = np.unique(units, return_inverse=True)
                n = np.bincount(at, counts[here][who], len(some)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(n)], names=["lang", "unit", "n"])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order_by: Column | None = None, max_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the rows of ``docs`` with a language and a text; whole texts are read.

    About ``max_docs`` rows at most are taken, by the hash of ``order_by`` (by default of the
    text). Every word and n-gram of them counts, however rare or long: the parameter alone
    bounds what reaches the driver and is broadcast, a number for each unit and language. No
    usable rows give a model without languages.
    """
    small_batches(docs.sparkSession)
    lang, text = F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang, text, F.pmod(F.xxhash64(order_by if order_by is not None else F.col(text_col)), F.lit(1_000_000)).alias("at"))
    share = min(1.0, max_docs / max(1, rows.count()))
    words = rows.where(F.col("at") < int(math.ceil(share * 1_000_000))).select("lang", "text").mapInArrow(_words, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    # each distinct word is cut into n-grams once
    units = written(words.mapInArrow(_units, "lang string, unit long, n long").groupBy("unit", "lang").agg(F.sum("n").alias("n")), "units")
    order = F.shiftrightunsigned("unit", 61)
    sums = {(r.o, r.lang): r.n for r in units.groupBy(order.alias("o"), "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in sums})
    if not langs:
        return Model([], np.empty(0, _U), np.empty((0, 0), np.float32), np.empty((8, 0), np.float32))
    by_unit = units.groupBy("unit").agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)))
    by_unit = written(by_unit, "by_unit")
    sizes = {r.o: r["count"] for r in by_unit.groupBy(order.alias("o")).count().collect()}
    # shares of an order's units, raised by half of what one unit is in the largest language: a unit
    # that a language lacks weighs alike in all of them, however much text each was learned from
    totals = [[max(1, sums.get((o, x), 0)) for x in langs] for o in range(8)]
    floor = [0.5 / max(row) for row in totals]
    whole = [1 + f * (sizes.get(o, 0) + 1) for o, f in enumerate(floor)]

    # numbers of an order as a table of eight rows: as literals they would be new code on every run
    schema = "o int, floor double, whole double, " + ", ".join(f"t{k} double" for k in range(len(langs)))
    by_order = docs.sparkSession.createDataFrame([(o, floor[o], whole[o], *map(float, totals[o])) for o in range(8)], schema)
    logs = [F.log((F.col(f"n{k}") / F.col(f"t{k}") + F.col("floor")) / F.col("whole")).cast("float").alias(f"l{k}") for k in range(len(langs))]
    table = by_unit.withColumn("o", order.cast("int")).join(F.broadcast(by_order), "o").select("unit", *logs).toArrow()
    names = table.column("unit").to_numpy().view(_U)
    place = np.argsort(names)
    logs = np.stack([table.column(f"l{k}").to_numpy()[place] for k in range(len(langs))], axis=1)
    return Model(langs, names[place], np.ascontiguousarray(logs), np.repeat(np.log(np.array(floor) / whole)[:, None], len(langs), axis=1).astype(np.float32))


class _Rows:
    """Rows of words: scores by language and, if ``known`` is asked for, the word's evidence; kept when first met."""

    def __init__(self, model: Model, known: bool = False) -> None:
        self.model, self.n, self.known = model, len(model.langs), known
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, self.n + (self.n + 1) * known), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """Places of the words in ``rows``."""
        if len(self.at) > _CACHE:
            self.at.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            first = len(self.at)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            here = slice(first, first + len(new))
            self.rows[here, : self.n] = self.model.scores(new)
            if self.known:
                # shorter words are alike in many languages
                long = np.array([len(w) + 2 >= ORDERS[0] for w in new])
                self.rows[here, self.n :] = self.model.evidence(new) * long[:, None]
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def predict(rows: _Rows, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and known shares of some texts.

    The score is the share of the best language when the mean score of up to 20 words speaks. It
    weighs the learned languages against each other only. The known share is that of the
    text's longest n-grams which training saw in the language: it is low for languages that
    were not learned and for random letters. Words too short for the longest n-grams count
    (whole) only where a text has no others. It is 0 if ``rows`` are without evidence.
    """
    words = [words_of(t) for t in texts] if rows.n else [[] for _ in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    langs, score, known = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    some = np.flatnonzero(sizes)
    if not len(some):
        return langs, score, known
    at = rows(list(chain.from_iterable(words)))
    starts = np.cumsum(sizes[some]) - sizes[some]
    means = np.add.reduceat(rows.rows[at], starts, axis=0, dtype=np.float64) / sizes[some, None]
    mean = means[:, : rows.n]
    best = mean.argmax(axis=1)
    odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(sizes[some], 20)[:, None])
    score[some] = 1.0 / odds.sum(axis=1)
    for k, b in zip(some.tolist(), best.tolist(), strict=True):
        langs[k] = rows.model.langs[b]
    if rows.known:
        found = means[:, rows.n :]
        for x in np.flatnonzero(found[:, -1] == 0):
            found[x] = rows.model.evidence(words[some[x]]).sum(axis=0, dtype=np.float64)
        known[some] = found[np.arange(len(some)), best] / found[:, -1]
    return langs, score, known


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), lang_out: str = "lang_pred", score_out: str = "score", known_out: str | None = None) -> DataFrame:
    """Columns ``keep`` of every row with the predicted language and a score from 0 to 1.

    The score compares the learned languages only, so it is high for other languages too; with
    ``known_out`` there is a column of this name with the known share of the text (see :func:`predict`).

    Only the text is looked at. A null text and a text without letters give ``und`` and 0; so
    does a model without languages. Equal scores take the first language in order; repeated
    rows give repeated rows; no rows give no rows. A ``keep`` column named like a result is an
    error.
    """
    results = [lang_out, score_out, *([known_out] if known_out else [])]
    clash = set(results) & set(keep)
    if clash:
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    small_batches(docs.sparkSession)
    shared, width = docs.sparkSession.sparkContext.broadcast(model), len(keep)
    kept = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:width]), f"`{lang_out}` string", *(f"`{c}` double" for c in results[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(shared.value, known_out is not None)
        for part in slices(batches):
            langs, *numbers = predict(rows, part.column(width).to_pylist())
            told = [pa.array(langs, pa.string()), *map(pa.array, numbers)][: len(results)]
            yield pa.RecordBatch.from_arrays([*part.columns[:width], *told], names=[*keep, *results])

    return kept.mapInArrow(run, schema)
