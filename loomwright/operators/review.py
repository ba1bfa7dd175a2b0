"""Review from end to end: complete proposals from judged pairs, and decisions applied in order.

A review is a fold over approved proposals: creations first, then merges, links, levels and
morphology. Each kind is a step of joins over all proposals at once; only merges that depend on
each other (one's loser is another's winner or loser) need rounds, each of which takes every
merge that no earlier open one touches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.functions.joins import grown
from loomwright.operators import merge, proposals
from loomwright.schemas import PROPOSAL

CAP, UNSOURCED, NO_LEDGER = "cap-reached", "unsourced-examples", "ledger-missing"
MORPHOLOGY = ("root", "lemmas", "separable", "family_transparency")
PROPOSAL_FIELDS = [f.strip().split(" ", 1) for f in " ".join(PROPOSAL.split()).split(", ")]


def _sides(nodes: DataFrame, id_name: str, prefix: str) -> DataFrame:
    return nodes.select(F.col("id").alias(id_name), F.col("source_ids").alias(f"{prefix}_sources"), F.col("body_md").alias(f"{prefix}_body"))


def complete(judged: DataFrame, candidates: DataFrame, nodes: DataFrame, caps: DataFrame, regenerated: DataFrame, now: Column) -> DataFrame:
    """All columns of a proposal for every fate and link of ``judged``.

    ``judged`` has ``candidate, other, rank, outcome, basis, confidence, similarity, tier, band,
    relation, direction, reason, b_adds, provider, model``; ``candidates(id, source_id, path,
    source_ids, body_md)`` are what they are about (a path: staged, else a node), ``nodes(id,
    source_ids, body_md)`` the others. ``caps(id, allowed, n_merges)`` says which winners may be
    written anew (a null count: the ledger can't be read), and ``regenerated(candidate, other,
    body_md, changelog, unsourced)`` has the bodies that a model wrote.

    A pair's winner keeps its body and gains new examples (``SAME``) or gets the new body
    (``OVERLAP``); a winner at its cap makes it a ``discard`` with the outcome ``MANUAL``. The
    id of a link names its relation. An overlap without a new body is left out: its model step
    has failed, and the next run asks again.
    """
    fate = merge.fates(judged.select("candidate", "other", "rank", "outcome"))
    rows = fate.join(grown(judged.drop("rank", "outcome")), ["candidate", "other"], "left")
    rows = rows.join(grown(candidates.select(F.col("id").alias("candidate"), "source_id", F.col("path").alias("candidate_path"), F.col("source_ids").alias("b_sources"), F.col("body_md").alias("b_body"))), "candidate")
    rows = rows.join(grown(_sides(nodes, "other", "a")), "other", "left")
    paired = rows.withColumns({"a": F.col("other"), "b": F.col("candidate"), "b_staged": F.col("candidate_path").isNotNull(), "a_count": F.size("a_sources"), "b_count": F.size("b_sources")})
    paired = merge.pick_winner(paired.withColumns({"a_sources_": F.col("a_sources"), "b_sources_": F.col("b_sources"), "a_sources": F.col("a_count"), "b_sources": F.col("b_count")}))
    merging = F.col("kind") == "merge"
    paired = paired.withColumns({"winner": F.when(merging, F.col("winner")), "loser": F.when(merging, F.col("loser"))})
    paired = paired.join(grown(caps.select(F.col("id").alias("winner"), "allowed", "n_merges", F.lit(True).alias("counted"))), "winner", "left")
    paired = paired.join(grown(regenerated.select("candidate", "other", F.col("body_md").alias("new_body"), F.col("changelog").alias("new_log"), "unsourced")), ["candidate", "other"], "left")

    overlap = merging & (F.col("outcome") == "OVERLAP")
    capped = overlap & ~F.coalesce("allowed", F.lit(True))
    paired = paired.where(~overlap | capped | F.col("new_body").isNotNull())
    a_wins = F.col("winner") == F.col("other")
    same = merge.same_body(F.when(a_wins, F.col("a_body")).otherwise(F.col("b_body")), F.when(a_wins, F.col("b_body")).otherwise(F.col("a_body")))
    refusal = F.concat(F.lit("The merge was refused: "), F.col("winner"), F.lit(" was regenerated "), F.coalesce(F.col("n_merges").cast("string"), F.lit("an unknown number of")), F.lit(" times."))
    forward = F.col("direction") == "a_to_b"
    source, target = F.when(forward, F.col("other")).otherwise(F.col("candidate")), F.when(forward, F.col("candidate")).otherwise(F.col("other"))
    edge = F.concat(F.lit("Edge: "), source, F.lit(" -"), F.col("relation"), F.lit("-> "), target, F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.col("reason"), F.lit("\n")), F.lit("")))
    kind = F.when(capped, "discard").otherwise(F.col("kind"))
    # a staged candidate's own file is what gets written, so its proposal has no second copy
    own_body = F.when(F.col("candidate_path").isNull(), F.col("b_body")).otherwise(F.lit(""))
    unread = overlap & F.coalesce("counted", F.lit(False)) & F.col("n_merges").isNull()
    value = {
        "id": T.proposal_id(kind, F.col("candidate"), F.col("other"), F.when(F.col("kind") == "link", F.col("relation"))),
        "kind": kind,
        "outcome": F.when(capped, "MANUAL").otherwise(F.col("outcome")),
        "counterpart": F.col("other"),
        "relation": F.when(F.col("kind") == "link", F.col("relation")),
        "direction": F.when(F.col("kind") == "link", F.col("direction")),
        "changelog": F.when(capped, refusal).when(overlap, F.col("new_log")).when(merging, F.concat(F.lit("SAME as "), F.col("winner"), F.lit(": its body stays, with sources and new examples of the other."))),
        "flags": merge.flags(F.col("confidence"), F.when(capped, CAP), F.when(overlap & ~capped & F.col("unsourced"), UNSOURCED), F.when(unread, NO_LEDGER)),
        "created_at": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"),
        "body_md": F.when(capped, refusal).when(overlap, F.col("new_body")).when(merging, same).when(F.col("kind") == "link", edge).otherwise(own_body),
    }
    out = [(value.get(name, F.col(name) if name in paired.columns else F.lit(None))).cast(type_).alias(name) for name, type_ in PROPOSAL_FIELDS]
    return paired.select(*out)


@dataclass
class Reviewed:
    """Tables after a review, and ``results(proposal_id, kind, state)`` of what was decided.

    Write ``ledger`` first: if writing nodes fails, it still says what was decided.
    """

    nodes: DataFrame
    staged: DataFrame
    pending: DataFrame
    ledger: DataFrame
    archived: DataFrame
    results: DataFrame


def _seq() -> Column:
    """Order within a kind: the most similar first, then by id; comparable without numbering all rows."""
    return F.struct((-F.coalesce("similarity", F.lit(0.0))).alias("far"), F.col("id").alias("name"))


def merge_rounds(nodes: DataFrame, staged: DataFrame, merges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(nodes, staged, gone, applied ids)`` after ``merges(id, winner, loser, outcome, body_md, seq)`` in the order of ``seq``.

    A loser may be staged; the winner has to be a node. A merge whose winner or loser is gone by
    its turn is not applied. Rounds are as many as the longest chain of merges that depend on
    each other, and every round is written.
    """
    rest = written(merges.where("winner <> loser"), "merges")
    gone = nodes.limit(0).withColumns({"winner": F.lit("")})
    done = merges.select("id").limit(0)
    while not rest.isEmpty():
        losers = rest.groupBy("loser").agg(F.min("seq").alias("first"))
        winners = rest.groupBy("winner").agg(F.min("seq").alias("first"))
        open_ = rest
        for side, table, key in (("winner", losers, "loser"), ("loser", losers, "loser"), ("loser", winners, "winner")):
            name = f"_{side}_{key}"
            open_ = open_.join(table.select(F.col(key).alias(side), F.col("first").alias(name)), side, "left")
        blocked = [F.coalesce(F.col(name) < F.col("seq"), F.lit(False)) for name in ("_winner_loser", "_loser_loser", "_loser_winner")]
        open_ = open_.withColumn("_stuck", blocked[0] | blocked[1] | blocked[2])
        # what a winner gets after a merge that has to wait waits too
        wait = open_.where("_stuck").groupBy("winner").agg(F.min("seq").alias("_wait"))
        ready = open_.join(wait, "winner", "left").where(~F.col("_stuck") & F.coalesce(F.col("seq") < F.col("_wait"), F.lit(True)))
        ready = written(ready.select(*merges.columns), "ready")
        from_staged = staged.join(ready.select(F.col("loser").alias("id")).distinct(), "id", "left_semi").join(nodes.select("id"), "id", "left_anti")
        pool = written(nodes.unionByName(from_staged.select(*nodes.columns)), "pool")
        good = ready.join(nodes.select(F.col("id").alias("winner")), "winner", "left_semi").join(pool.select(F.col("id").alias("loser")), "loser", "left_semi")
        good = written(good, "good")
        kept, lost = merge.apply_merges(pool, good, now)
        # what was added from the staged rows is gone, as a loser, or was not asked for
        kept = kept.join(from_staged.select("id"), "id", "left_anti")
        nodes, lost = written(kept, "nodes"), written(lost, "lost")
        staged = written(staged.join(good.select(F.col("loser").alias("id")).distinct(), "id", "left_anti"), "staged")
        gone, done = gone.unionByName(lost.select(*gone.columns)), done.unionByName(good.select("id"))
        rest = written(rest.join(ready.select("id"), "id", "left_anti"), "merges")
    return nodes, staged, gone, done


def add_links(nodes: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(nodes, states)`` after links ``id, source, target, relation, confidence, seq`` between nodes.

    The first of equal edges is added, to the end of its source's links; ``states(id, state)``
    says ``applied``, ``unchanged`` (there already) or ``refused`` (an end is no node).
    """
    ends = nodes.select("id", "links")
    held = links.join(ends.select(F.col("id").alias("source"), F.coalesce("links", F.array().cast(dict(nodes.dtypes)["links"])).alias("held")), "source", "left")
    held = held.join(ends.select(F.col("id").alias("target"), F.lit(True).alias("there")), "target", "left")
    first = links.groupBy("source", "target", "relation").agg(F.min("seq").alias("first"))
    held = held.join(first, ["source", "target", "relation"], "left")
    has = F.exists("held", lambda x: (x["target"] == F.col("target")) & (x["relation"] == F.col("relation")))
    whole = F.col("held").isNotNull() & F.col("there") & F.col("relation").isNotNull()
    state = F.when(~F.coalesce(whole, F.lit(False)), "refused").when(has | (F.col("seq") != F.col("first")), "unchanged").otherwise("applied")
    told = written(held.select("id", "source", "target", "relation", "confidence", "seq", state.alias("state")), "links")
    new = told.where("state = 'applied'").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("target", "relation", "confidence").alias("link")))).alias("_new"))
    joined = nodes.join(new, "id", "left")
    more = F.concat(F.coalesce("links", F.array().cast(dict(nodes.dtypes)["links"])), F.transform("_new", lambda x: x["link"]))
    hit = F.col("_new").isNotNull()
    joined = joined.withColumns({"links": F.when(hit, more).otherwise(F.col("links")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    return joined.select(*nodes.columns), told.select("id", "state")


def set_fields(nodes: DataFrame, changes: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """Nodes after ``changes(candidate, seq, fields)``: of each field the last that is not null; each change counts one version."""
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields]
    new = changes.groupBy(F.col("candidate").alias("id")).agg(*last, F.count("*").cast("int").alias("_times"))
    joined, hit = nodes.join(new, "id", "left"), F.col("_times").isNotNull()
    sets = {f: F.coalesce(f"_{f}", f) for f in fields}
    sets |= {"version": F.when(hit, F.coalesce("version", F.lit(1)) + F.col("_times")).otherwise(F.col("version")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return joined.withColumns(sets).select(*nodes.columns)


def _on_hash(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on a key whose texts begin alike: sorted by its hash first, so that numbers are compared."""
    return left.withColumn("_hash", F.xxhash64(key)).join(right.withColumn("_hash", F.xxhash64(key)), ["_hash", key], how).drop("_hash")


def _slim(rows: DataFrame, staged: bool) -> DataFrame:
    """Rows that leave their bodies where they are: ``body_md`` is null until a merge names the proposal whose body stands."""
    return rows.withColumns({"body_md": F.lit(None).cast("string"), "_staged": F.lit(staged)})


def _bodied(rows: DataFrame, nodes: DataFrame, staged: DataFrame, pending: DataFrame, columns: list[str]) -> DataFrame:
    """Slim rows (to be read several times) with bodies again: of the proposal that they name, else their own."""
    rows = rows.withColumnRenamed("body_md", "_by")
    told = pending.where("kind = 'merge'").select(F.col("id").alias("_by"), "body_md")
    parts = [rows.where("_by is not null").join(told, "_by", "left")]
    for held, side in ((nodes, "not _staged"), (staged, "_staged")):
        parts.append(rows.where(f"_by is null and {side}").join(held.select("id", "body_md"), "id", "left"))
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def review(nodes: DataFrame, staged: DataFrame, pending: DataFrame, decisions: DataFrame, ledger: DataFrame | None, archived: DataFrame, now: Column) -> Reviewed:
    """Apply ``decisions(proposal_id, approved, decided_at, note)`` to ``pending`` proposals.

    ``nodes`` and ``staged`` have the same columns, with ``id, links, source_ids, body_md, cefr,
    cefr_basis, version, status, updated_at`` and the fields of morphology. A decision that the
    ledger has (by its id: time and proposal) is not taken again, so a replay changes nothing.
    What can't be applied (a merge or link whose side is gone, a change that says nothing) is
    ``refused``: it gets no ledger row and stays pending. A creation whose id is a node's is
    recorded before that shows, so it has a row, and stays pending too.

    An id is one node's and one staged row's. Bodies are not carried through the steps: they
    stay where they are and are joined once, to what comes out.
    """
    decided = _on_hash(pending.drop("body_md"), decisions.select(F.col("proposal_id").alias("id"), "approved", "decided_at", "note"), "id")
    if ledger is not None:
        named = decided.withColumn("decision_id", proposals.decision_id(F.col("id"), F.col("decided_at")))
        decided = _on_hash(named, ledger.select("decision_id"), "decision_id", "left_anti").drop("decision_id")
    decided = written(decided, "decided")
    if decided.isEmpty():
        # nothing is new, so nothing changes
        none = proposals.record(decided, F.col("approved"), F.col("decided_at"), F.col("note"))
        gone = proposals.archive(nodes.limit(0).withColumn("winner", F.lit("")), archived, now)
        return Reviewed(written(nodes, "nodes"), staged, pending, none, gone, decided.select(F.col("id").alias("proposal_id"), "kind", F.lit("").alias("state")))
    whole, waiting = nodes, staged
    nodes, staged = _slim(nodes, False), _slim(staged, True)
    yes = decided.where("approved").withColumn("seq", _seq())
    creates = yes.where("kind = 'create'")
    own = lambda df, name: df.select(F.col("id").alias("candidate"), F.lit(True).alias(name))
    created = creates.join(own(nodes, "is_node"), "candidate", "left").join(own(staged, "is_staged"), "candidate", "left")
    states = [created.select("id", "kind", F.when(F.col("is_node"), "recorded").when(F.col("is_staged"), "applied").otherwise("refused").alias("state"))]
    nodes, _, staged = proposals.apply_creates(nodes, creates.select("candidate"), staged)

    merges = yes.where("kind = 'merge'").select("id", "winner", "loser", "outcome", F.col("id").alias("body_md"), "seq")
    nodes, staged, gone, applied = merge_rounds(written(nodes, "created"), written(staged, "staged"), merges, now)
    states.append(merges.select("id").join(applied.withColumn("state", F.lit("applied")), "id", "left").select("id", F.lit("merge").alias("kind"), F.coalesce("state", F.lit("refused")).alias("state")))
    # from here on no node comes or goes
    there = nodes.select(F.col("id").alias("candidate"), F.lit(True).alias("there"))

    forward = F.col("direction") == "a_to_b"
    links = yes.where("kind = 'link'").select("id", F.when(forward, F.col("counterpart")).otherwise(F.col("candidate")).alias("source"), F.when(forward, F.col("candidate")).otherwise(F.col("counterpart")).alias("target"), "relation", "confidence", "seq")
    nodes, told = add_links(nodes, links, now)
    states.append(told.select("id", F.lit("link").alias("kind"), "state"))

    for kind, fields, needs in (("relevel", ["cefr", "cefr_basis"], ["cefr"]), ("morphology", list(MORPHOLOGY), list(MORPHOLOGY))):
        says = F.exists(F.array(*(F.col(f).isNotNull() for f in needs)), lambda x: x)
        asked = yes.where(F.col("kind") == kind)
        good = says & F.coalesce("there", F.lit(False))
        states.append(asked.join(there, "candidate", "left").select("id", "kind", F.when(good, "applied").otherwise("refused").alias("state")))
        nodes = set_fields(nodes, asked.where(says), fields, now)
    states.append(yes.where("kind = 'discard'").select("id", "kind", F.lit("applied").alias("state")))
    states.append(decided.where("not approved").select("id", "kind", F.lit("rejected").alias("state")))

    results = written(reduce(DataFrame.unionByName, states).select(F.col("id").alias("proposal_id"), "kind", "state"), "results")
    rows = _on_hash(decided, results.where("state <> 'refused'").select(F.col("proposal_id").alias("id"), "state"), "id")
    # a link that is there already says so where nothing else is said
    note = F.coalesce("note", F.when(F.col("state") == "unchanged", "already linked"))
    recorded = proposals.record(rows.withColumn("_note", note), F.col("approved"), F.col("decided_at"), F.col("_note"))
    settled = results.where("state in ('applied', 'unchanged', 'rejected')").select(F.col("proposal_id").alias("id"))
    nodes = _bodied(written(nodes, "slim"), whole, waiting, pending, whole.columns)
    gone = _bodied(gone, whole, waiting, pending, [*whole.columns, "winner"])
    left = waiting.join(staged.select("id"), "id", "left_semi")
    return Reviewed(written(nodes, "nodes"), left, pending.join(settled, "id", "left_anti"), written(recorded, "ledger"), written(proposals.archive(gone, archived, now), "archived"), results)
