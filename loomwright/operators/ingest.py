"""Ingest: source ids from content, page checks, candidate caps, node ids, promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.functions.running import earlier

# How long a hash is written, and the limits of sources.
HASH_WIDTHS = (8, 12, 16, 24, 32, 64)
MOST_CANDIDATES, PAGE_CHARS, TEXT_PAGE_RATIO, IMAGE_BYTES = 8, 40, 0.5, 10 * 1024 * 1024
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}


def page_flags(pages: DataFrame, least: int = PAGE_CHARS) -> DataFrame:
    """``pages(doc_id, page, text)`` with ``has_text``: enough characters once stripped."""
    return pages.withColumn("has_text", F.length(T.strip(F.col("text"))) >= least)


def page_summary(pages: DataFrame, least: int = PAGE_CHARS, ratio: float = TEXT_PAGE_RATIO) -> DataFrame:
    """Pages, text pages, their ratio, whether the document has a text layer, and its empty pages."""
    flagged = page_flags(pages, least).groupBy("doc_id")
    out = flagged.agg(F.count("*").alias("pages"), F.sum(F.col("has_text").cast("long")).alias("text_pages"), F.array_sort(F.collect_list(F.when(~F.col("has_text"), F.col("page")))).alias("_empty"))
    share = F.col("text_pages") / F.col("pages")
    return out.select("doc_id", "pages", "text_pages", share.alias("ratio"), (share >= ratio).alias("has_text_layer"), F.array_join(F.transform("_empty", lambda p: p.cast("string")), ",").alias("empty_pages"))


def document_rollup(pages: DataFrame) -> DataFrame:
    """``doc_id, pages, cost_usd, unpriced, source_ids`` of ``pages(doc_id, page, source_id, cost_usd)``.

    A page without a price adds nothing to the cost and is counted as unpriced; sources are in
    page order. A document's pages are one row's array: they are bounded by a file's pages.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct("page", "source_id"))), lambda x: x["source_id"])
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), F.array_compact(ids).alias("source_ids"))


def source_ids(sources: DataFrame, stamp: str, existing: DataFrame | None = None) -> DataFrame:
    """``name, digest, source_id, is_new`` of ``sources(name, content[, page])``.

    The id is date, slug of the name, page, and as much of the content's hash as tells it from
    other contents of that date and slug, old ones (``existing(source_id, digest)``) too. Equal
    contents under one slug are one source.
    """
    rows = sources if "page" in sources.columns else sources.withColumn("page", F.lit(None).cast("int"))
    slug = T.slugify(F.regexp_replace("name", r"\.[^./]*$", ""))
    stem = F.concat_ws("-", F.lit(stamp), slug, F.when(F.col("page").isNotNull(), F.concat(F.lit("p"), F.col("page").cast("string"))))
    rows = rows.select("name", T.content_hash(F.col("content")).alias("digest"), stem.alias("stem"))
    if existing is None:
        existing = rows.limit(0).select(F.lit("").alias("source_id"), "digest")
    known = existing.select(F.col("source_id").alias("source_id"), F.col("digest").alias("old"))
    distinct = rows.select("stem", "digest").distinct()
    # a width serves if no other content of the stem shares that much of the hash
    wide = distinct.withColumn("width", F.explode(F.array(*map(F.lit, HASH_WIDTHS)))).withColumn("prefix", F.expr("substring(digest, 1, width)"))
    wide = wide.withColumn("source_id", F.concat_ws("-", "stem", "prefix"))
    first = wide.groupBy("source_id").agg(F.min("digest").alias("holder"))
    wide = wide.join(first, "source_id").join(known, "source_id", "left")
    free = F.when(F.col("old").isNotNull(), F.col("old") == F.col("digest")).otherwise(F.col("holder") == F.col("digest"))
    best = wide.where(free).groupBy("stem", "digest").agg(F.min_by("source_id", "width").alias("source_id"), F.min_by(F.col("old").isNull(), "width").alias("is_new"))
    return rows.join(best, ["stem", "digest"]).select("name", "digest", "source_id", "is_new")


def cap_candidates(candidates: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The first candidates of each source, by ``seq``: a rule of the format, more are an error of the model."""
    order = Window.partitionBy("source_id").orderBy("seq")
    return candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


#: Rows of a bucket when the candidates of one slug are put in order.
BUCKET = 4096
_NUMBERED = r"^(.+)-([1-9][0-9]{0,17})$"


def _numbered(name: Column) -> tuple[Column, Column]:
    """What stands before a number from 2 on, and the number; null for other names."""
    stem, number = F.regexp_extract(name, _NUMBERED, 1), F.regexp_extract(name, _NUMBERED, 2)
    whole = name.rlike(_NUMBERED) & (F.coalesce(F.try_to_number(number, F.lit("9" * 18)).cast("long"), F.lit(0)) >= 2)
    return F.when(whole, stem), F.when(whole, number).cast("long")


def node_ids(candidates: DataFrame, taken: DataFrame) -> DataFrame:
    """``seq, title_de, node_id``: slugs, numbered from -2 where taken by ``taken(id)`` or an earlier candidate.

    Each candidate of a slug takes its next number that is free (the bare slug counts as 1): the
    i-th of them the i-th free one, which running sums over taken numbers and candidates tell,
    so no task holds all candidates of a slug. Slugs meet where one is another with a number
    (``x-2`` beside ``x``): the name goes to the first candidate of ``x-2``, unless ``x`` had so
    many candidates before that it came to 2 by itself. Such claims are settled slug by slug,
    the shorter first; a slug's claims are one row, as many as there are slugs ``x-<number>``.
    """
    rows = written(candidates.select("seq", "title_de", T.node_slug(F.col("title_de")).alias("base")), "candidates")
    low, high, many = rows.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    width = (high - low) // max(1, many // BUCKET) + 1 if many else 1
    # in doubles, as sequence numbers may span all 64 bits; they keep the order
    slot = F.floor((F.col("seq").cast("double") - F.lit(float(low or 0))) / F.lit(float(width))).cast("long")

    bases = rows.groupBy("base").agg(F.min("seq").alias("first"))
    stem, number = _numbered(F.col("base"))
    names = bases.select(F.col("base").alias("stem"), F.lit(True).alias("has_parent"))
    bases = written(bases.withColumns({"stem": stem, "number": number}).join(names, "stem", "left"), "bases")
    ids = taken.select(F.col("id").cast("string").alias("id")).distinct()
    id_stem, id_number = _numbered(F.col("id"))
    held = ids.select(F.col("id").alias("base"), F.lit(1).cast("long").alias("number")).unionByName(ids.select(id_stem.alias("base"), id_number.alias("number")).where("base is not null"))
    held = written(held.join(bases.select("base"), "base", "left_semi"), "held")
    # a slug that is another's number claims that name, if it is free at all
    bare = held.where("number = 1").select("base")
    claims = written(bases.where("has_parent").join(bare, "base", "left_anti").select(F.col("stem").alias("base"), "number", F.col("base").alias("child"), F.col("first").alias("seq")), "claims")

    # how many candidates of its slug come before each candidate, and before each claim
    lined = rows.select("base", "seq", F.lit(1).alias("one"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("child"), "title_de")
    lined = lined.unionByName(claims.select("base", "seq", F.lit(0).alias("one"), "number", "child", F.lit(None).cast("string").alias("title_de")))
    lined = written(earlier(lined, ["base"], slot, ["seq", "one"], "one"), "lined")
    level = bases.where("has_parent is null").select("base")
    lost = bases.select("base").limit(0)
    out: list[DataFrame] = []
    while not level.isEmpty():
        level = written(level, "level")
        own = held.join(level, "base", "left_semi").unionByName(lost.join(level, "base", "left_semi").select("base", F.lit(1).cast("long").alias("number"))).distinct()
        asked = lined.where("one = 0").join(level, "base", "left_semi")
        # the place of a claimed name among the free ones
        both = own.select("base", "number", F.lit(1).alias("is_held"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("came")).unionByName(asked.select("base", "number", F.lit(0).alias("is_held"), "child", F.col("before").cast("long").alias("came")))
        placed = earlier(both, ["base"], F.floor(F.col("number") / BUCKET).cast("long"), ["number"], "is_held").where("is_held = 0")
        placed = placed.withColumn("place", F.col("number") - F.col("before"))
        start = F.struct(F.lit(0).cast("long").alias("skipped"), F.array().cast("array<struct<number:bigint,child:string,taken:boolean>>").alias("told"))

        def settle(acc: Column, x: Column) -> Column:
            # the candidate that would come to this number was there before the claim
            reached = x["place"] - acc["skipped"] <= x["came"]
            told = F.concat(acc["told"], F.array(F.struct(x["number"].alias("number"), x["child"].alias("child"), reached.alias("taken"))))
            return F.struct((acc["skipped"] + F.when(reached, 0).otherwise(1)).cast("long").alias("skipped"), told.alias("told"))

        folded = placed.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("number", "place", "came", "child"))).alias("claims"))
        settled = written(folded.select("base", F.explode(F.aggregate("claims", start, settle, lambda acc: acc["told"])).alias("x")).select("base", "x.*"), "settled")
        gone = own.unionByName(settled.where("not taken").select("base", "number"))
        # free numbers before each taken one; the i-th candidate passes those with fewer than i before them
        steps = earlier(gone.withColumn("one", F.lit(1)), ["base"], F.floor(F.col("number") / BUCKET).cast("long"), ["number"], "one")
        steps = steps.select("base", (F.col("number") - 1 - F.col("before")).alias("key"), F.lit(1).alias("step"), F.lit(None).cast(dict(rows.dtypes)["seq"]).alias("seq"), F.lit(None).cast("string").alias("title_de"))
        turns = lined.where("one = 1").join(level, "base", "left_semi").select("base", (F.col("before") + 1).cast("long").alias("key"), F.lit(0).alias("step"), "seq", "title_de")
        dealt = earlier(turns.unionByName(steps), ["base"], F.floor(F.col("key") / BUCKET).cast("long"), ["key", "step"], "step").where("step = 0")
        n = F.col("key") + F.col("before")
        out.append(written(dealt.select("seq", "title_de", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("node_id")), "dealt"))
        lost = written(lost.unionByName(settled.where("taken").select(F.col("child").alias("base"))), "lost")
        level = bases.join(level.withColumnRenamed("base", "stem"), "stem", "left_semi").where("has_parent").select("base")
    return reduce(DataFrame.unionByName, out, rows.select("seq", "title_de", F.col("base").alias("node_id")).limit(0))


def to_nodes(candidates: DataFrame, now: Column) -> DataFrame:
    """Draft nodes of candidates that have ``node_id`` and ``source_id``; the basis says that a model set the level."""
    basis = F.concat_ws("; ", F.lit("llm:extraction"), F.nullif(F.col("cefr_basis"), F.lit("")))
    return candidates.select(
        F.col("node_id").alias("id"), "title_de", "title_en", "type", "cefr", basis.alias("cefr_basis"), "register", "themes", F.array("source_id").alias("source_ids"),
        "confidence", F.lit("draft").alias("status"), F.lit(1).alias("version"), now.alias("updated_at"), "body_md",
    )


def promote(staged: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``: a staged node whose id exists is refused."""
    ids = nodes.select("id")
    return staged.join(ids, "id", "left_anti"), staged.join(ids, "id", "left_semi")


def gate(rows: DataFrame, nodes: DataFrame, expect_exists: bool) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` of node rows to be written: changes need their node, creations must not have one.

    Tags of accepted rows are what is learned (:func:`learned_tags`).
    """
    ids = nodes.select("id").distinct()
    there, lacking = rows.join(ids, "id", "left_semi"), rows.join(ids, "id", "left_anti")
    return (there, lacking) if expect_exists else (lacking, there)


def learned_tags(accepted: DataFrame, known: DataFrame) -> DataFrame:
    """Tags of accepted nodes that the vocabulary lacks."""
    return accepted.select(F.explode("themes").alias("tag")).select(T.norm_tag(F.col("tag")).alias("tag")).where("tag <> ''").distinct().join(known.select("tag"), "tag", "left_anti")


def taken_ids(nodes: DataFrame, queue: DataFrame) -> DataFrame:
    return nodes.select("id").unionByName(queue.select("id")).distinct()


def check_images(files: DataFrame, most: int = IMAGE_BYTES) -> DataFrame:
    """``binaryFile`` rows with ``media_type`` and ``error`` (null: fine)."""
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    media = F.create_map(*[F.lit(x) for kv in IMAGE_TYPES.items() for x in kv])
    kind = F.try_element_at(media, suffix)
    error = F.when(kind.isNull(), "unsupported type").when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large")
    return files.withColumn("media_type", kind).withColumn("error", error)
