"""Proposals from start to end: which pairs need a model, what is proposed, decided, recorded and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.joins import grown
from loomwright.operators.dedup import GRAY_HIGH
from loomwright.operators.index import upsert
from loomwright.operators.merge import fates
from loomwright.schemas import DECISION, PROPOSAL
from loomwright.sources.files import exists

WRITING = ("merge", "create")
REJECTED = "rejected at review"


def needs_call(pairs: DataFrame, high: float = GRAY_HIGH) -> DataFrame:
    """Pairs that only a model can settle; those at or over ``high`` are the same without one."""
    return pairs.where(F.col("similarity") < high)


def adjudicate(pairs: DataFrame, verdicts: DataFrame, high: float = GRAY_HIGH) -> DataFrame:
    """``candidate, other, rank, outcome, basis, confidence`` of ``pairs(candidate, other, rank, similarity)``.

    ``verdicts(candidate, other, outcome, confidence)`` are a model's answers for the pairs of
    :func:`needs_call`; a pair under ``high`` without one is left out, to be asked again.
    """
    same = F.col("similarity") >= high
    both = pairs.join(grown(verdicts), ["candidate", "other"], "left").where(same | F.col("outcome").isNotNull())
    return both.select("candidate", "other", "rank", F.when(same, "SAME").otherwise(F.col("outcome")).alias("outcome"), F.when(same, "threshold").otherwise("llm").alias("basis"), F.when(same, F.col("similarity")).otherwise(F.col("confidence")).alias("confidence"))


def propose(judged: DataFrame, allowed: DataFrame) -> DataFrame:
    """One proposal a fate of each candidate: ``id, kind, outcome, candidate, counterpart``.

    A merge into a node that ``allowed(id, allowed)`` refuses becomes a ``discard`` with the
    outcome ``MANUAL``: approving it writes nothing, so a person has to act.
    """
    rows = fates(judged.select("candidate", "other", "rank", "outcome")).join(allowed.select(F.col("id").alias("other"), "allowed"), "other", "left")
    capped = (F.col("kind") == "merge") & (F.col("outcome") == "OVERLAP") & ~F.coalesce("allowed", F.lit(True))
    rows = rows.withColumns({"kind": F.when(capped, "discard").otherwise(F.col("kind")), "outcome": F.when(capped, "MANUAL").otherwise(F.col("outcome"))})
    return rows.select(T.proposal_id(F.col("kind"), F.col("candidate"), F.col("other")).alias("id"), "kind", "outcome", "candidate", F.col("other").alias("counterpart"))


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Pending proposals; none if there are no files. A bad line fails the read."""
    return spark.read.schema(PROPOSAL).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], PROPOSAL)


def write_proposals(pending: DataFrame, new: DataFrame, path: str) -> None:
    """Pending and new proposals as JSON lines in another folder; a new one replaces one of its id."""
    upsert(pending, new, "id").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def resolve(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """What is pending once decided proposals, approved or not, are gone."""
    return pending.join(decisions.select(F.col("proposal_id").alias("id")).distinct(), "id", "left_anti")


def listing(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "id")


def by_kind(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("kind").agg(F.count("*").alias("proposals"), F.sum(writes_body(F.col("kind")).cast("long")).alias("writing"))


def writes_body(kind: Column) -> Column:
    return kind.isin(list(WRITING))


def needs_human(status: Column) -> Column:
    """Whether a person could settle a withheld word, as opposed to more study."""
    return status == "variable-stress"


def rules_grounded(derived: Column, used_tiebreak: Column) -> Column:
    return derived.isNotNull() & ~F.coalesce(used_tiebreak, F.lit(False))


def decision_id(proposal: Column, now: Column) -> Column:
    return F.concat_ws("-", F.date_format(now, "yyyyMMdd'T'HHmmss"), proposal)


def record(proposals: DataFrame, approved: Column, now: Column, note: Column | None = None) -> DataFrame:
    """Ledger rows of decided proposals, with the ledger's columns; what a proposal lacks is null.

    Append them before the nodes are written: if the write is refused, the ledger still says
    what was decided. A change log stands over a note; a rejection without either says so.
    """
    said = F.coalesce(*([F.col("changelog")] if "changelog" in proposals.columns else []), note if note is not None else F.lit(None).cast("string"), F.when(~approved, F.lit(REJECTED)))
    own = {"decision_id": decision_id(F.col("id"), now), "proposal_id": F.col("id"), "decided_at": now, "approved": approved, "changelog": said}
    out = []
    for field in T_DECISION.split(","):
        name, kind = field.strip().split(" ", 1)
        value = own.get(name, F.col(name) if name in proposals.columns else F.lit(None))
        out.append(value.cast(kind).alias(name))
    return proposals.select(*out)


T_DECISION = " ".join(DECISION.split())


def sides(wanted: DataFrame, nodes: DataFrame, staged: DataFrame) -> DataFrame:
    """Node rows of ``wanted(id)``: the accepted node if there is one, else the staged one. A lacking one fails the query."""
    names = [c for c in nodes.columns if c != "id"]
    pack = lambda df, name: df.select("id", F.struct(*names).alias(name))
    both = wanted.select("id").join(pack(nodes, "_node"), "id", "left").join(pack(staged, "_staged"), "id", "left")
    lost = F.raise_error(F.concat(F.lit("neither a node nor staged: "), F.col("id").cast("string")))
    either = F.when(F.col("_node").isNotNull(), F.col("_node")).when(F.col("_staged").isNotNull(), F.col("_staged")).otherwise(lost)
    return both.select("id", either.alias("x")).select("id", "x.*")


def apply_creates(nodes: DataFrame, approved: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, refused, still staged)`` after approved creations ``approved(candidate)``.

    The staged row is what is written, not the proposal's copy of it. A candidate whose id is a
    node's already is refused and stays staged, as one that was not approved does.
    """
    wanted = staged.join(approved.select(F.col("candidate").alias("id")).distinct(), "id", "left_semi")
    ids = nodes.select("id")
    new, refused = wanted.join(ids, "id", "left_anti"), wanted.join(ids, "id", "left_semi")
    return nodes.unionByName(new.select(*nodes.columns)), refused, staged.join(new.select("id"), "id", "left_anti")


def archive(gone: DataFrame, archived: DataFrame, now: Column) -> DataFrame:
    """``name, node_id, merged_into, merged_at`` and the node's row for each of ``gone`` (which has ``id, winner``).

    The name is the node's id, with a number from -2 on if that id was archived before
    (``archived(node_id)``): two nodes can have one id at different times.
    """
    before = archived.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("_before"))
    order = Window.partitionBy("id").orderBy("winner")
    rows = gone.join(before, "id", "left").withColumn("_n", F.coalesce("_before", F.lit(0)) + F.row_number().over(order))
    name = F.when(F.col("_n") == 1, F.col("id").cast("string")).otherwise(F.concat_ws("-", "id", F.col("_n").cast("string")))
    rest = [c for c in gone.columns if c not in ("id", "winner")]
    return rows.select(name.alias("name"), F.col("id").alias("node_id"), F.col("winner").alias("merged_into"), now.alias("merged_at"), *rest)
