"""MinHash near-duplicate detection with odd sketches; links are confirmed on full sets.

1. One pass over the texts makes each text's shingle set and, from it, a set key, MinHash
   band keys and an odd sketch: a parity bitmap that each (sample, value) toggles one bit of.
   The population count of the XOR of two sketches estimates their similarity closely when it
   is high, so it says which candidates of the bands are worth confirming.
2. Texts of one set fold into a class (a plain aggregation), whatever the size of the group.
3. In each band bucket every member is paired with the bucket's least member only. The pairs
   the sketches leave are confirmed on the full sets and joined into components.
4. In buckets that still hold several components, the pairs of different components are
   compared in blocks inside a task: each pair in the first band it shares only. First the
   sketches alone tell which members may link at all; only these texts are fetched, and their
   full sets compared, skipping what has been joined meanwhile. A task returns the links that
   join something, never the pairs. So no pair that shares a band is left undecided.

Keys that hold a large part of the rows (a band of boilerplate, a hub, a set with very many
copies) are dealt to several parts before they are shuffled.

Two texts at similarity 0.8 share none of 32 bands of 4 samples with chance 5e-8; a true pair
falls to the sketch test with chance 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import connected_components
from loomwright.llm.neardup_kernel import Sketcher, most_differing_bits, overlap, set_key, shingle_set
from loomwright.llm.shared import IdFilter, slices, small_batches, spread_join, written

WIDTH, PERCENT = 5, 80
BANDS, ROWS, SAMPLES, BITS = 32, 4, 256, 1024
BLOCK = 512


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(BANDS, ROWS, SAMPLES, BITS)
        for part in slices(batches):
            ids, rows = part.column(0), []
            for text in part.column(1):
                data = text.as_py()
                sets = shingle_set(data.encode().lower(), width) if data else np.empty(0, np.uint64)
                if not len(sets):
                    rows.append((0, 0, 0, None, None))
                    continue
                low = sketcher.minhash(sets)
                rows.append((len(sets), *set_key(sets), sketcher.band_keys(low).tolist(), sketcher.odd_sketch(low).tolist()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True))], schema=schema)

    return run


def _confirm(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] = ("", np.empty(0, np.uint64))
        for part in slices(batches, 64, 4 << 20):
            out = []
            for a, b, ta, tb in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if ta != held[0]:
                    held = (ta, shingle_set(ta.encode().lower(), width))
                sb = shingle_set(tb.encode().lower(), width)
                both = overlap(held[1], sb)
                if both and 100 * both >= percent * (len(held[1]) + len(sb) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


_MEMBER = "key long, band int, rep long, component long, block int, bi int, bj int, bands array<long>, sketch array<long>"


class _Bucket:
    """One bucket, or two blocks of one: which members may link across components, by their sketches."""

    def __init__(self, table: pa.Table, cut: int) -> None:
        self.ids, self.comps = table["rep"].to_numpy(), table["component"].to_numpy()
        self.blocks, self.across = table["block"].to_numpy(), table["bi"][0].as_py() != table["bj"][0].as_py()
        # counting bits of signed numbers counts those of their size
        self.bands, self.sketch = (_matrix(table[x]) for x in ("bands", "sketch"))
        self.sketch = self.sketch.view(np.uint64)
        self.band, self.cut = table["band"][0].as_py(), cut

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with those after it, by id, that it may link with; the likest first."""
        order = np.argsort(self.ids, kind="stable")
        for x, i in enumerate(order[:-1]):
            rest = order[x + 1 :]
            rest = rest[(self.comps[rest] != self.comps[i]) & (self.ids[rest] != self.ids[i])]
            if self.across:
                rest = rest[self.blocks[rest] != self.blocks[i]]
            # a pair belongs to the first band that it shares
            rest = rest[~(self.bands[rest, : self.band] == self.bands[i, : self.band]).any(axis=1)]
            if not len(rest):
                continue
            bits = np.bitwise_count(self.sketch[rest] ^ self.sketch[i]).sum(axis=1)
            few = bits <= self.cut
            if few.any():
                yield int(i), rest[few][np.argsort(bits[few], kind="stable")]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _meet(cut: int):
    """Members of a bucket whose sketch allows a link with a member of another component."""
    def run(table: pa.Table) -> pa.Table:
        bucket, keep = _Bucket(table, cut), np.zeros(table.num_rows, bool)
        for i, near in bucket.near():
            keep[i] = True
            keep[near] = True
        return table.select([x.split()[0] for x in _MEMBER.split(", ")]).filter(pa.array(keep))

    return run


def _settle(width: int, percent: int, cut: int):
    """Links between components of one bucket (or of two blocks of one): those that join something."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        bucket, texts = _Bucket(table, cut), table["text"]
        ids, comps = bucket.ids, bucket.comps
        root = {int(c): int(c) for c in comps}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sets: dict[int, np.ndarray] = {}

        def get(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[int(i)].as_py().encode().lower(), width)
            return sets[i]

        found = []
        for i, near in bucket.near():
            for j in near:
                ri, rj = find(int(comps[i])), find(int(comps[j]))
                if ri == rj:
                    continue
                both = overlap(get(i), get(j))
                if 100 * both >= percent * (len(get(i)) + len(get(j)) - both):
                    found.append((int(ids[i]), int(ids[j])))
                    root[max(ri, rj)] = min(ri, rj)
        cols = list(zip(*found, strict=True)) or [(), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct ``width``-word shingles; a text of fewer words is one shingle. A null or wordless
    text has an empty set and no links. ``component_id`` is the least id that links lead to,
    ``kept`` marks the document that stays. Repeated rows give repeated results; rows that
    share an id but not a text each follow their own text. A row with a null id takes the
    component of its copies (null without any) and is kept only if it has none. Other columns
    of ``docs`` are neither read nor returned; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not _repeats(docs, "doc_id"):
        return _classes(docs, width, percent)
    # an id with several rows names no text: rows are numbered, and classes named by their least id
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    row = F.when(F.col("doc_id").isNotNull(), F.col("row"))
    found = written(_classes(docs.select(row.alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("row"), "n_shingles", "component_id"), "rows")
    own = written(found.where("row is not null").join(docs.select("row", "doc_id"), "row"), "named")
    least = own.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    # a row without an id takes the class of its copies
    every = own.unionByName(found.where("row is null").withColumn("doc_id", F.lit(None).cast("long")))
    out = spread_join(every, least.drop("size"), ["component_id"], least.select("component_id", "size"), "row", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """:func:`near_duplicates` of documents with unique or null ids."""
    texts = docs.where("text is not null and doc_id is not null")
    cut = most_differing_bits(percent / 100, SAMPLES)
    keys = ["n", "k1", "k2"]
    sig = docs.mapInArrow(_signatures(width), "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")
    sig = written(sig, "signatures")
    # equal sets have equal bands and sketches; copies are summed before they travel
    reps = sig.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("size"))
    reps = written(reps, "representatives")
    marked = reps.where("rep is not null").select("rep", "bands", "sketch").dropDuplicates(["rep"])

    member = reps.where("rep is not null").select("rep", F.posexplode("bands").alias("band", "key"))
    hubs = member.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = written(hubs, "hubs")
    member = written(spread_join(member, hubs, ["key"], hubs, "rep"), "members")

    star = written(member.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    fans = star.groupBy("a").agg(F.count("*").alias("size"))
    sketch = marked.select("rep", "sketch")
    star = star.join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    star = spread_join(star, sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), ["a"], fans, "b")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    star = written(star.where(differ <= cut).select("a", "b"), "candidates")

    ends = star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = texts.where(IdFilter(ends, "doc_id").may_hold("doc_id"))
    fans = star.groupBy("a").agg(F.count("*").alias("size"))
    pairs = star.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    pairs = spread_join(pairs, some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), ["a"], fans, "b")
    links = pairs.select("a", "b", "ta", "tb").mapInArrow(_confirm(width, percent), "a long, b long")
    part = written(connected_components(links, "a", "b"), "parts")

    # buckets that still hold several components and more than the pairs with their hub; a
    # bucket's members are dealt to its blocks before they are shuffled
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    member = member.where("size > 2").join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = member.withColumn("block", F.pmod(F.xxhash64("rep"), count).cast("int"))
    open_ = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("size").alias("size")).where("lo <> hi")
    open_ = open_.select("key", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    member = member.join(open_, ["key", "block"]).where("rep <> hub")
    member = written(member.select("key", "band", "rep", "component", "block", "size"), "open")
    # first the sketches alone, so that only texts that may link something travel
    wide = member.join(marked, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    wide = wide.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "size")
    near = written(wide.groupBy("key", "bi", "bj").applyInArrow(_meet(cut), _MEMBER), "near")
    ends = near.select(F.col("rep").alias("doc_id")).distinct()
    full = texts.where(IdFilter(ends, "doc_id").may_hold("doc_id")).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    more = near.join(full, "rep").groupBy("key", "bi", "bj").applyInArrow(_settle(width, percent, cut), "a long, b long")
    links = part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)

    comp = connected_components(links, "a", "b")
    named = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*keys, F.coalesce("component", "rep").alias("component_id"))
    out = spread_join(sig.select("doc_id", *keys), named, keys, reps.select(*keys, "size"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the component.

    Only rows that a fixed bitmap of the dropped ids may hold are shuffled, for the exact
    anti-join; all others pass where they are read. Repeated rows of one id become one row; rows
    with a null id stay, as no id tells them apart.
    """
    verdict = written(near_duplicates(docs, id_col, text_col, width, percent), "verdicts")
    twice = verdict.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = verdict.where("not kept").select("doc_id")
    ids = written(gone.select("doc_id", F.lit(True).alias("gone")).unionByName(twice.select("doc_id", F.lit(False).alias("gone"))).groupBy("doc_id").agg(F.max("gone").alias("gone")), "dropped")
    hold = IdFilter(ids, "doc_id").may_hold(id_col)
    rest = docs.where(F.coalesce(~hold, F.lit(True)))
    mark = F.col(id_col).alias("__id")
    touched = docs.where(hold).withColumn("__id", mark).join(ids.select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone")), "__id", "left")
    fine = touched.where("__gone is null").select(*docs.columns)
    once = touched.where("__gone = false").dropDuplicates(["__id"]).select(*docs.columns)
    return rest.select(*docs.columns).unionByName(fine).unionByName(once)
