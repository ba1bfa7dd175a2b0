"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A k-mer is ``k`` code points in a row; its inner substrings are the ``s``-mers in it. It is
chosen, as an anchor, if the least of their hashes stands at its first or last place. Whether
a k-mer is chosen depends on its own characters alone, so an edit moves no anchor outside the
k-mers that it touches, and consecutive anchors are never more than ``k - s`` apart. Anchors
keep their places: fingerprints are alike as far as they share anchors, and neighbouring
anchors at the same distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import let
from loomwright.llm.shared import IdFilter, written

K, S = 24, 6
#: Ids to a bucket, as a power of two, when documents are put in order.
BUCKET = 8


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors of a text, ``array<struct<at: int, hash: bigint>>``: place in code points and k-mer hash, in order.

    A text of fewer than ``k`` code points is one k-mer of all of them; a text without any
    (or null) has no anchors. ``s`` must divide ``k``, as a k-mer is hashed by the ``s``-mers
    that make it up.
    """
    if not 0 < s < k or k % s:
        raise ValueError("the inner substrings must be shorter than the k-mers and make them up")
    last = k - s
    text = F.coalesce(text, F.lit(""))

    def over(g: Column) -> Column:
        def least(x: Column, rest: list[Column]) -> Column:
            # most s-mers fail within a few comparisons, and nested to the right no more are looked at;
            # outside the text they compare with null and fail too
            return reduce(lambda later, y: (x <= y) & later, reversed(rest[:-1]), x <= rest[-1])

        def at(x: Column, i: Column) -> Column:
            first = least(x, [F.get(g, i + j) for j in range(1, last + 1)])
            final = least(F.get(g, i + last), [F.get(g, i + j) for j in reversed(range(last))])
            return F.when(first | final, i)

        def named(i: Column) -> Column:
            return F.struct(i.alias("at"), F.xxhash64(*(F.get(g, i + j) for j in range(0, k, s))).alias("hash"))

        return F.transform(F.array_compact(F.transform(g, at)), named)

    inner = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{s}}})).")), lambda x: F.xxhash64(x))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(text, F.lit(k)).alias("hash")))
    return F.when(F.length(text) >= k, let(inner, over)).when(text != "", whole).otherwise(F.slice(whole, 1, 0))


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text: see :func:`anchors`."""
    return anchors(text, k, s)


def features(print_: Column) -> Column:
    """What two fingerprints are compared by, as distinct hashes: anchors, and neighbours with their distance."""
    def link(x: Column, i: Column) -> Column:
        after = F.get(print_, i + 1)
        return F.when(after.isNotNull(), F.xxhash64(x["hash"], after["at"] - x["at"], after["hash"]))

    return F.array_distinct(F.concat(F.transform(print_, lambda x: x["hash"]), F.array_compact(F.transform(print_, link))))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the :func:`features` of two fingerprints, 0 to 1; two empty ones are alike."""
    def ratio(x: Column) -> Column:
        union = x["a"] + x["b"] - x["both"]
        return F.when(union == 0, F.lit(1.0)).otherwise(x["both"] / union)

    sizes = lambda a, b: F.struct(F.size(a).alias("a"), F.size(b).alias("b"), F.size(F.array_intersect(a, b)).alias("both"))
    return let(a, lambda x: let(b, lambda y: let(sizes(x, y), ratio)))


def as_text(print_: Column) -> Column:
    """Place and hash of each anchor in hexadecimal digits, ``at:hash``, by spaces."""
    return F.lower(F.array_join(F.transform(print_, lambda x: F.concat(F.hex(x["at"]), F.lit(":"), F.hex(x["hash"]))), " "))


def _following(buckets: DataFrame) -> DataFrame:
    """``bucket, onto``: for each bucket the next higher one, for the highest the lowest.

    Buckets are dealt to tasks by ranges of about equal numbers, whatever the ids are, and put in
    order there; one task orders the ranges' own first buckets, which are one row for each task.
    """
    dealt = written(buckets.select("bucket").repartitionByRange("bucket").withColumn("range", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("onto", F.lead("bucket").over(Window.partitionBy("range").orderBy("bucket")))
    ends = dealt.groupBy("range").agg(F.min("bucket").alias("low"))
    order = Window.orderBy("range")
    rest = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("low").over(order), F.first("low").over(rest)).alias("next_low"))
    return inside.join(ends, "range").select("bucket", F.coalesce("onto", "next_low").alias("onto"))


def with_next(docs: DataFrame, id_col: str, text_col: str, extra=lambda text: {}) -> DataFrame:
    """Each document beside the next one in descending id order; after the last comes the first.

    Returns ``doc_id, text`` and the columns of ``extra`` (computed from the text, once), and
    the same of the next document with the prefix ``next_``. Ids are put in order within
    buckets of 256 ids; the first document of each bucket is also sent to the next higher one,
    so one shuffle of the texts suffices and no task holds them all. Rows of one id follow each
    other by text; null ids come last, null texts count as empty. Rows of one id share a task.
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), order.alias("okey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.shiftright(order, BUCKET).alias("bucket"))
    tops = base.groupBy("bucket").agg(F.max("okey").alias("okey"))
    tops = written(tops.join(_following(tops.select("bucket")), "bucket").select("okey", "onto"), "tops")
    held = base.where(IdFilter(tops, "okey").may_hold("okey")).join(tops, "okey")
    copies = held.groupBy("okey", "onto").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    rows = base.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "okey", "text", F.col("onto").alias("bucket"), F.lit(True).alias("copy")))
    # only texts are shuffled; what follows from them is made behind the shuffle, where the window needs no other
    rows = rows.repartition("bucket")
    own = extra(F.col("text"))
    rows = rows.select("doc_id", "okey", "text", "bucket", "copy", *(c.alias(n) for n, c in own.items()))
    inside = Window.partitionBy("bucket").orderBy("copy", F.desc("okey"), "text")
    rows = rows.select("doc_id", "text", "copy", *own, *(F.lead(n).over(inside).alias(f"next_{n}") for n in ("text", *own)))
    return rows.where(~F.col("copy")).drop("copy")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and what they are like.

    The edited text has the last third of the code points replaced by as many of the next
    document's first (see :func:`with_next`). Returns ``doc_id, n_chars, edited, fingerprint,
    edited_fingerprint`` (arrays of anchors), ``near_edited`` and ``near_next``. A null text
    counts as empty; a lone document is its own next one; repeated rows each get a row; no rows
    give no rows; other columns are not read.
    """
    rows = with_next(docs, id_col, text_col, lambda text: {"fingerprint": fingerprint(text, k, s)})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_fingerprint", _of_edited(F.col("edited"), n - cut, F.col("fingerprint"), F.col("next_fingerprint"), k, s))
    near = let(features(F.col("fingerprint")), lambda f: F.struct(likeness(f, features(F.col("edited_fingerprint"))).alias("edited"), likeness(f, features(F.col("next_fingerprint"))).alias("next")))
    rows = rows.withColumn("near", near)
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))


def _of_edited(edited: Column, at: Column, head: Column, tail: Column, k: int, s: int) -> Column:
    """Anchors of a text made of the first ``at`` code points of one and the first of another.

    As anchors are free of context, those inside either part are known from its fingerprint;
    only the k-mers across the border are read again.
    """
    def joined(x: Column) -> Column:
        # lengths are known here: within the filters they would be counted for each anchor
        at, border, size = x["at"], x["border"], x["size"]
        moved = lambda y, by: F.struct((y["at"] + by).alias("at"), y["hash"].alias("hash"))
        across = F.filter(F.transform(anchors(x["text"], k, s), lambda y: moved(y, border)), lambda y: (y["at"] < at) & (y["at"] + k > at))
        return F.concat(F.filter(head, lambda y: y["at"] + k <= at), across, F.transform(F.filter(tail, lambda y: y["at"] + k <= size - at), lambda y: moved(y, at)))

    border = F.greatest(at - (k - 1), F.lit(0))
    known = F.struct(at.alias("at"), border.alias("border"), F.length(edited).alias("size"), F.substring(edited, border + 1, F.lit(2 * k - 2)).alias("text"))
    return F.when(F.length(edited) >= 2 * k, let(known, joined)).otherwise(anchors(edited, k, s))
