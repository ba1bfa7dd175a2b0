"""Fates from verdicts, and applying approved merges, links, levels and morphology; creations are in ``proposals``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.joins import grown
from loomwright.operators.ledger import REGENERATING

MERGING, LOW_CONFIDENCE = ("SAME", "OVERLAP"), 0.6
DEMOTES = {"stable": "reviewed"}


def undecided(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    return pairs.join(grown(decided.select("left_id", "right_id")), ["left_id", "right_id"], "left_anti")


def pick_winner(pairs: DataFrame) -> DataFrame:
    """``winner`` and ``loser`` of ``a, b, a_sources, b_sources, b_staged``: staged loses, then fewer sources, then the greater id."""
    a_wins = F.when(F.col("b_staged"), True).when(F.col("a_sources") != F.col("b_sources"), F.col("a_sources") > F.col("b_sources")).otherwise(F.col("a") <= F.col("b"))
    return pairs.withColumn("winner", F.when(a_wins, F.col("a")).otherwise(F.col("b"))).withColumn("loser", F.when(a_wins, F.col("b")).otherwise(F.col("a")))


def fates(verdicts: DataFrame) -> DataFrame:
    """One proposal kind for each verdict of ``candidate, other, rank, outcome``: the first merging one is a candidate's fate.

    Links count only where nothing merges; a candidate without a fate is created.
    """
    merging = F.col("outcome").isin(list(MERGING))
    w = Window.partitionBy("candidate")
    marked = verdicts.withColumn("fate", F.min(F.when(merging, F.col("rank"))).over(w))
    # the verdicts are read once: a candidate's first row also stands for its creation
    marked = marked.withColumn("nth", F.row_number().over(w.orderBy("rank")))
    kind = F.when(merging & (F.col("rank") == F.col("fate")), "merge").when(F.col("fate").isNull() & (F.col("outcome") == "DISTINCT_RELATED"), "link")
    own = F.when(kind.isNotNull(), F.struct("other", "outcome", kind.alias("kind")))
    lone = F.struct(F.lit(None).cast(dict(verdicts.dtypes)["other"]).alias("other"), F.lit("DISTINCT").alias("outcome"), F.lit("create").alias("kind"))
    lone = F.when(F.col("fate").isNull() & (F.col("nth") == 1), lone)
    return marked.select("candidate", F.explode(F.array_compact(F.array(own, lone))).alias("x")).select("candidate", "x.*")


def new_examples(winner_body: Column, loser_body: Column, form: T.Form = T.plain) -> Column:
    """Example lines of the loser that the winner lacks, in order."""
    have = F.transform(T.example_lines(winner_body), lambda x: T.fold_words(x, form))
    return F.filter(T.example_lines(loser_body), lambda x: ~F.array_contains(have, T.fold_words(x, form)))


def unsourced_examples(body: Column, sources: Column, form: T.Form = T.plain) -> Column:
    """Example lines found in none of the source texts (an array), compared by letters and digits."""
    hay = T.fold_words(F.array_join(F.filter(sources, lambda s: s.isNotNull() & (s != "")), "\n"), form)
    return F.filter(T.example_lines(body), lambda x: (T.fold_words(x, form) != "") & ~F.contains(hay, T.fold_words(x, form)))


def same_body(winner_body: Column, loser_body: Column) -> Column:
    """The winner's body with the loser's new examples after it."""
    extra = new_examples(winner_body, loser_body)
    head = F.when(F.size(T.example_lines(winner_body)) == 0, F.lit("\n\n## Examples")).otherwise(F.lit(""))
    body = F.regexp_replace(winner_body, r"(?U)\s+$", "")
    return F.when(F.size(extra) == 0, winner_body).otherwise(F.concat(body, head, F.lit("\n"), F.array_join(F.transform(extra, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")))


def status_after(status: Column, outcome: Column) -> Column:
    out = status
    for old, new in DEMOTES.items():
        out = F.when((outcome == REGENERATING) & (status == old), F.lit(new)).otherwise(out)
    return out


def union_sources(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def flags(confidence: Column, *more: Column) -> Column:
    return F.array_compact(F.array(*more, F.when(confidence < LOW_CONFIDENCE, "low-confidence")))


def apply_merges(nodes: DataFrame, merges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(nodes, archived)`` after approved merges ``winner, loser, outcome, body_md, seq``.

    Several merges into one winner apply in the order of ``seq``: the last body stands, sources
    add up in order, each counts one version, and any regeneration costs a stable status. A
    merge whose winner or loser does not exist is not applied.
    """
    ids = nodes.select("id")
    good = merges.join(ids.withColumnRenamed("id", "winner"), "winner", "left_semi").join(nodes.select(F.col("id").alias("loser"), F.col("source_ids").alias("loser_sources")), "loser")
    done = good.groupBy("winner").agg(
        F.max_by("body_md", "seq").alias("new_body"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "loser_sources"))), lambda x: x["loser_sources"])).alias("more"),
        F.count("*").cast("int").alias("times"),
        F.max(F.col("outcome") == REGENERATING).alias("regenerated"),
    )
    joined = nodes.join(done.withColumnRenamed("winner", "id"), "id", "left").join(good.select(F.col("loser").alias("id")).distinct(), "id", "left_anti")
    hit = F.col("times").isNotNull()
    after = {
        "body_md": F.when(hit, F.col("new_body")).otherwise(F.col("body_md")),
        "source_ids": F.when(hit, union_sources(F.col("source_ids"), F.col("more"))).otherwise(F.col("source_ids")),
        "version": F.when(hit, F.coalesce("version", F.lit(1)) + F.col("times")).otherwise(F.col("version")),
        "status": F.when(hit & F.col("regenerated"), status_after(F.col("status"), F.lit(REGENERATING))).otherwise(F.col("status")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    kept = joined.withColumns({k: v for k, v in after.items() if k in nodes.columns}).select(*nodes.columns)
    gone = nodes.join(good.select(F.col("loser").alias("id"), "winner").distinct(), "id")
    return kept, gone


def apply_links(links: DataFrame, approved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges after approved ones ``source_id, target, relation``: repeated ones add nothing, dangling ones are refused."""
    ids = nodes.select("id")
    new = approved.select("source_id", "target", "relation").distinct().join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    new = new.join(links.select("source_id", "target", "relation"), ["source_id", "target", "relation"], "left_anti").select("source_id", "target", "relation")
    return links.select("source_id", "target", "relation").unionByName(new)


def apply_changes(nodes: DataFrame, approved: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """Nodes after approved level or morphology changes ``id`` and ``fields``: only non-null fields are set."""
    new = approved.select("id", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_hit"))
    joined = nodes.join(new, "id", "left")
    sets = {f: F.coalesce(f"_{f}", f) for f in fields}
    if "version" in nodes.columns:
        sets["version"] = F.when(F.col("_hit"), F.coalesce("version", F.lit(1)) + 1).otherwise(F.col("version"))
    if "updated_at" in nodes.columns:
        sets["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(sets).select(*nodes.columns)
