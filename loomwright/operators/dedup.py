"""Duplicates in three tiers, the cheaper first: exact hash, exact shingle similarity, vectors.

A pair is reported by the first tier that finds it. All inputs are ``(id, text)`` or
``(id, vector)`` with an optional boolean ``focus``: then one side of a pair must be in focus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.functions.joins import grown
from loomwright.operators.pivots import PivotIndex
from loomwright.operators.sketches import SHORT, compared, near_sketches, set_sizes, sketch

NEAR_EXACT, GRAY_LOW, GRAY_HIGH, NEIGHBOURS = 0.85, 0.87, 0.95, 10
PAIR = ["left_id", "right_id"]


def band(similarity: Column, high: float = GRAY_HIGH) -> Column:
    """All tiers share this cut-off, the near-exact one too."""
    return F.when(similarity >= high, "duplicate").otherwise("gray")


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")


def corpus_of(focus: DataFrame, against: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Focus and corpus as one frame with ``focus``; a focus row replaces a corpus row of its id."""
    focus = focus.withColumn("focus", F.lit(True))
    if against is None:
        return focus
    return focus.unionByName(against.join(focus.select(id_col), id_col, "left_anti").withColumn("focus", F.lit(False)))


def with_focus(rows: DataFrame) -> DataFrame:
    return rows if "focus" in rows.columns else rows.withColumn("focus", F.lit(True))


def exact_pairs(rows: DataFrame, form: T.Form = T.plain) -> DataFrame:
    """``left_id, right_id, similarity`` of texts that are equal once normalised."""
    keyed = with_focus(rows).select("id", "focus", T.content_hash(T.normalize_for_hash(F.col("text"), form)).alias("hash"))
    a, b = keyed.alias("a"), keyed.alias("b")
    both = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.focus") | F.col("b.focus")))
    return both.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.lit(1.0).alias("similarity"))


def exact_groups(rows: DataFrame, form: T.Form = T.plain) -> DataFrame:
    """``hash, first_id, members, pairs`` of each group of equal texts: a plain aggregation."""
    keyed = rows.select("id", T.content_hash(T.normalize_for_hash(F.col("text"), form)).alias("hash"))
    groups = keyed.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("members"))
    return groups.where("members > 1").withColumn("pairs", F.expr("members * (members - 1) div 2"))


def shingle_sizes(rows: DataFrame, size: int = T.SHINGLE, form: T.Form = T.plain) -> DataFrame:
    return set_sizes(rows.select("id", T.normalize_for_hash(F.col("text"), form).alias("norm")), size)


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """``hash, n, focus, sig, own, need`` of short texts: two sets of that similarity share ``need`` signatures.

    In classes of up to :data:`SHORT` grams (see :mod:`loomwright.operators.sketches`) a set of
    ``n`` sends its ``n - ceil(t n) + 1`` least gram hashes: two sets of that similarity have one
    of them in common. A set takes part in its own class (``own``) and the one below.
    """
    step = -math.log(threshold)
    size_class = F.floor(F.log(F.col("n").cast("double") + 1e-9) / step).cast("int")
    both = sets.withColumn("own_class", size_class).withColumn("class", F.explode(F.array(F.col("own_class"), F.col("own_class") - 1))).withColumn("own", F.col("class") == F.col("own_class"))
    few = F.exp((F.col("class") + 1) * step) <= SHORT
    first = F.slice(F.array_sort("grams"), F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    return both.where(few).select("hash", "n", "focus", "own", F.lit(1).alias("need"), F.explode(F.transform(first, lambda g: F.xxhash64("class", F.lit("gram"), g))).alias("sig"))


def matching_signatures(sig: DataFrame, threshold: float) -> DataFrame:
    """``ha, hb`` of sets that share as many of ``signatures`` as any pair of that similarity does, the first of them in focus."""
    a, b = sig.where("focus").alias("a"), sig.alias("b")
    once = (F.col("a.hash") < F.col("b.hash")) | ~F.col("b.focus")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & once & T.could_reach(F.col("a.n"), F.col("b.n"), threshold) & (F.col("a.own") | F.col("b.own")))
    met = met.groupBy(F.col("a.hash").alias("ha"), F.col("b.hash").alias("hb")).agg(F.count("*").alias("shared"), F.max(F.greatest("a.need", "b.need")).alias("need"))
    return met.where("shared >= need").select("ha", "hb")


def similar_texts(sketches: DataFrame, texts: DataFrame, threshold: float, size: int = T.SHINGLE) -> DataFrame:
    """``ha, hb, similarity`` of texts that are as similar, one of them in focus; ``texts(hash, norm)`` has those of all ``sketches``.

    Short texts meet by :func:`signatures`, all others by :func:`near_sketches`; whoever has met
    is compared as a whole set of grams, made from its text then. What is sent for that grows with
    the texts that have met, in parts of families, not with their pairs.
    """
    short = signatures(sketches.where("grams is not null").select("hash", "n", "focus", "grams"), threshold)
    # hashes don't compress, so Spark's guess of their size holds: few of them spare the texts a shuffle
    met = written(near_sketches(sketches, threshold).unionByName(matching_signatures(short, threshold)), "met")
    some = met.select(F.col("ha").alias("hash")).unionByName(met.select(F.col("hb").alias("hash"))).distinct()
    return compared(met, written(texts.select("hash", "norm").join(some, "hash", "left_semi"), "candidates"), threshold, size)


def near_exact_pairs(rows: DataFrame, threshold: float = NEAR_EXACT, size: int = T.SHINGLE, form: T.Form = T.plain, drop_exact: bool = True) -> DataFrame:
    """``left_id, right_id, similarity``: exact Jaccard at or over ``threshold``, less exact pairs.

    Equal texts fold into one first, so copies meet once. Candidates have sketches or signatures
    (:func:`similar_texts`; none is missed) and sizes that allow the similarity; they are then
    compared as whole sets of grams, by 64-bit hashes. A text without shingles is in no pair.
    """
    rows = with_focus(rows)
    keyed = rows.select("id", "focus", T.normalize_for_hash(F.col("text"), form).alias("norm")).withColumn("hash", F.unhex(T.content_hash(F.col("norm"))))
    texts = written(keyed.where("norm <> ''").groupBy("hash").agg(F.first("norm").alias("norm"), F.max("focus").alias("focus")), "texts")
    links = similar_texts(written(sketch(texts, threshold, size), "sketches"), texts, threshold, size)
    # texts equal as sets but not as strings are near-exact too; equal strings only if asked for
    members = keyed.select("hash", "id", "focus")
    left = members.select(F.col("hash").alias("ha"), F.col("id").alias("ia"), F.col("focus").alias("fa"))
    right = members.select(F.col("hash").alias("hb"), F.col("id").alias("ib"), F.col("focus").alias("fb"))
    pairs = links.join(grown(left), "ha").join(grown(right), "hb").where("fa or fb").select(*ordered_pair(F.col("ia"), F.col("ib")), "similarity")
    if drop_exact:
        return pairs
    same = keyed.where("norm <> ''").select("hash", "id", "focus")
    a, b = same.alias("a"), same.alias("b")
    same = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.focus") | F.col("b.focus")))
    return pairs.unionByName(same.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.lit(1.0).alias("similarity")))


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double: vectors are kept at unit length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def nearest(focus: DataFrame, index: DataFrame, k: int = NEIGHBOURS, digits: int = 6, least: float | None = None) -> DataFrame:
    """``id, other, similarity, rank``: k nearest vectors of each focus row, itself left out. Exact; see :mod:`loomwright.operators.pivots`."""
    return PivotIndex(index).nearest(focus, k, digits, least)


def semantic_pairs(focus: DataFrame, index: DataFrame, seen: DataFrame | None = None, low: float = GRAY_LOW, k: int = NEIGHBOURS) -> DataFrame:
    """Pairs among the k nearest at or over ``low``; pairs of earlier tiers use up places but are dropped."""
    near = nearest(focus, index, k, least=low)
    pairs = near.select(*ordered_pair(F.col("id"), F.col("other")), "similarity").groupBy(*PAIR).agg(F.max("similarity").alias("similarity"))
    # pairs that are seen grow with the square of a group of copies, and compress to a fraction in a file
    return pairs.join(grown(seen.select(*PAIR)), PAIR, "left_anti") if seen is not None else pairs


def report(rows: DataFrame, vectors: DataFrame | None = None, near: float = NEAR_EXACT, low: float = GRAY_LOW, high: float = GRAY_HIGH, k: int = NEIGHBOURS, form: T.Form = T.plain) -> DataFrame:
    """``left_id, right_id, tier, similarity, band`` of all three tiers, each pair once."""
    exact = exact_pairs(rows, form).withColumn("tier", F.lit("exact"))
    almost = near_exact_pairs(rows, near, form=form).withColumn("tier", F.lit("near-exact"))
    found = exact.unionByName(almost)
    if vectors is not None:
        found = written(found, "text_pairs")
        marked = vectors.join(grown(with_focus(rows).select("id", "focus")), "id")
        found = found.unionByName(semantic_pairs(marked.where("focus"), marked, found, low, k).withColumn("tier", F.lit("semantic")))
    return found.select(*PAIR, "tier", "similarity", band(F.col("similarity"), high).alias("band"))


def report_order(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("similarity"), *PAIR)


def focus_in_corpus(focus: DataFrame, corpus: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of the focus that the corpus holds too: worth a warning, as the focus row replaces the other."""
    return focus.select(id_col).distinct().join(corpus.select(id_col), id_col, "left_semi")
