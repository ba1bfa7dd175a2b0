"""From pairs to complete proposals: decided pairs go, a model judges the gray ones, overlaps get a new body."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.folders import written
from loomwright.functions.joins import grown
from loomwright.operators import ledger, merge, models, proposals, review, steps


@dataclass
class Proposed:
    """Proposals with all their columns, and the pairs whose model step failed (``candidate, other, step, error``)."""

    proposals: DataFrame
    failed: DataFrame


def raw_sources(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """``id, texts`` of ``nodes(id, source_ids, body_md)``: a node's own body, then the raw texts behind it, in the order of its sources.

    A source without a raw text adds none. A node's texts are bounded by its sources.
    """
    named = nodes.select("id", F.posexplode("source_ids").alias("at", "source_id")).join(grown(raw.select("source_id", "text")), "source_id")
    texts = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    return nodes.select("id", F.array("body_md").alias("own")).join(grown(texts), "id", "left").select("id", F.concat("own", F.coalesce("texts", F.array().cast("array<string>"))).alias("texts"))


def propose_all(pairs: DataFrame, candidates: DataFrame, nodes: DataFrame, decisions: DataFrame | None, raw: DataFrame, client: models.Client, model: str, provider: str, now: Column, cache: DataFrame | None = None) -> Proposed:
    """Proposals for all ``candidates(id, source_id, path, title_de, title_en, type, cefr, source_ids, body_md)``.

    ``pairs(candidate, other, rank, similarity, tier, band)`` are their neighbours among
    ``nodes`` (the same columns less path and source, and ``version``). Pairs that a merge
    decision has named go; near-equal ones are the same without a call. A candidate without
    neighbours is created. A pair whose step fails is left for the next run, and so is its
    candidate: without all verdicts its fate is not known.
    """
    if decisions is not None:
        decided = ledger.decided_pairs(decisions)
        ordered = pairs.withColumns({"left_id": F.least("candidate", "other"), "right_id": F.greatest("candidate", "other")})
        pairs = merge.undecided(ordered, decided).drop("left_id", "right_id")
    pairs = written(pairs, "pairs")
    shown = ("title_de", "title_en", "type", "cefr", "body_md")
    side = lambda df, name, label: df.select(F.col("id").alias(name), steps.render(label, *map(F.col, shown)).alias(f"{label.lower()}_shown"))
    a, b = side(nodes, "other", "A"), side(candidates, "candidate", "B")
    asked = proposals.needs_call(pairs).select("candidate", "other").join(grown(a), "other").join(grown(b), "candidate")
    said = written(steps.run(asked, steps.ADJUDICATE, steps.pair_text(F.col("a_shown"), F.col("b_shown")), client, model, cache), "verdicts")
    failed = said.where("error is not null").select("candidate", "other", F.lit("adjudicate").alias("step"), "error")
    verdicts = said.where("error is null").select("candidate", "other", "value.*")
    open_ = pairs.join(grown(failed.select("candidate").distinct()), "candidate", "left_anti")
    judged = proposals.adjudicate(open_, verdicts).join(grown(pairs.select("candidate", "other", "similarity", "tier", "band")), ["candidate", "other"])
    told = F.col("basis") == "llm"
    judged = judged.join(grown(verdicts.select("candidate", "other", "relation", "direction", "reason", "b_adds")), ["candidate", "other"], "left")
    judged = judged.withColumns({"provider": F.when(told, provider), "model": F.when(told, model)})
    judged = written(judged, "judged")
    # who has no neighbour is created; its row names nobody
    alone = candidates.select(F.col("id").alias("candidate")).join(grown(pairs.select("candidate").distinct()), "candidate", "left_anti")
    for field in judged.schema.fields[1:]:
        alone = alone.withColumn(field.name, F.lit("DISTINCT" if field.name == "outcome" else None).cast(field.dataType))
    judged = judged.unionByName(alone)

    caps = written(ledger.check_cap(nodes, decisions), "caps")
    overlaps = merge.fates(judged.select("candidate", "other", "rank", "outcome")).where("kind = 'merge' and outcome = 'OVERLAP'").select("candidate", "other")
    overlaps = overlaps.join(grown(caps.where("allowed").select(F.col("id").alias("other"))), "other", "left_semi").join(grown(judged.select("candidate", "other", "b_adds")), ["candidate", "other"])
    texts = raw_sources(nodes.select("id", "source_ids", "body_md").unionByName(candidates.select("id", "source_ids", "body_md")), raw)
    sides = overlaps.join(grown(a), "other").join(grown(b), "candidate")
    sides = sides.join(grown(texts.select(F.col("id").alias("other"), F.col("texts").alias("a_texts"))), "other").join(grown(texts.select(F.col("id").alias("candidate"), F.col("texts").alias("b_texts"))), "candidate")
    sides = sides.select("candidate", "other", F.col("a_shown").alias("a"), F.col("b_shown").alias("b"), "b_adds", F.concat("a_texts", "b_texts").alias("sources"))
    new = written(steps.regenerated(sides, client, model, cache), "regenerated")
    lost = overlaps.join(grown(new), ["candidate", "other"], "left_anti").select("candidate", "other", F.lit("regenerate").alias("step"), F.lit("refused").alias("error"))
    out = review.complete(judged, candidates.select("id", "source_id", "path", "source_ids", "body_md"), nodes.select("id", "source_ids", "body_md"), caps, new, now)
    return Proposed(out, failed.unionByName(lost))
