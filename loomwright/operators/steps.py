"""The six model steps: what each asks, what a good answer is, and how one is run.

A step is a stated task, the fields of its answer and their allowed values. Running one builds
the messages (fixed parts first, what varies last), asks the cache and then the injected client,
checks answers strictly and asks refused ones again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.joins import grown
from loomwright.operators import merge, models
from loomwright.schemas import CANDIDATE, LEVELS, NODE_TYPES, TRANSPARENCIES

# Verdicts on a pair, relations of an edge, and the ways that it can point.
OUTCOMES = ("SAME", "OVERLAP", "DISTINCT_RELATED", "DISTINCT")
RELATIONS = ("governs", "prerequisite_for", "contrasts_with", "formal_variant_of", "same_family", "false_friend_of", "exception_to")
DIRECTIONS = ("a_to_b", "b_to_a")
_CANDIDATES = "array<struct<" + ", ".join(f.strip().replace(" ", ":", 1) for f in " ".join(CANDIDATE.split()).split(", ")) + ">>"


@dataclass(frozen=True)
class Step:
    """A model step; without ``fields`` its answer is plain text."""

    name: str
    version: str
    task: str
    fields: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def shape(self) -> str | None:
        """What the answer must look like, as the prompt says it."""
        if not self.fields:
            return None
        lines = [f'  "{k}": {v}' + (f", one of {', '.join(self.enums[k])}" if k in self.enums else "") + (" (may be left out)" if k in self.optional else "") for k, v in self.fields.items()]
        return "Answer with one JSON object and nothing else:\n{\n" + ",\n".join(lines) + "\n}"

    def prompt(self, variable: Column, shots: list[tuple[str, str]] | None = None) -> Column:
        """The messages as JSON."""
        return F.to_json(models.messages(F.lit(self.task), shots or [], variable, self.shape()))

    def check(self, answer: Column, finish_reason: Column) -> tuple[Column, Column]:
        """``(value, error)`` of an answer."""
        if not self.fields:
            bare = T.strip(F.coalesce(answer, F.lit("")))
            error = F.when(finish_reason == "length", "truncated").when(bare == "", "empty")
            return F.when(error.isNull(), F.struct(bare.alias("text"))), error
        value, error = models.parse(answer, finish_reason, self.fields, self.enums, self.optional)
        if self.name == "adjudicate":
            relation, direction, lacks = models.coherent(value)
            value = F.when(value.isNotNull(), value.withField("relation", relation).withField("direction", direction))
            error = F.coalesce(error, lacks)
        if self.name == "extract":
            wrong = F.exists(value["candidates"], lambda c: ~F.coalesce(c["type"].isin(list(NODE_TYPES)) & c["cefr"].isin(list(LEVELS)) & (T.strip(c["title_de"]) != "") & (c["body_md"] != ""), F.lit(False)))
            error = F.coalesce(error, F.when(value["candidates"].isNull(), "missing-candidates").when(wrong, "bad-candidate"))
        if self.name == "regenerate":
            error = F.coalesce(error, F.when(T.strip(value["body_md"]) == "", "empty-body"))
        return F.when(error.isNull(), value), error


EXTRACT = Step(
    "extract", "1",
    "You read a source about the German language. List each concept that it teaches as a note of its own: a German and an English title, what kind of note it is, its level, themes, and a short body in Markdown that keeps to what the source says.",
    {"candidates": _CANDIDATES},
)
ADJUDICATE = Step(
    "adjudicate", "1",
    "You compare two notes, A and B. Say whether they are the same concept, overlap so that B adds something to A, are distinct but related, or are distinct. If B adds something, say what; if they are related, name the relation and its direction.",
    {"outcome": "string", "confidence": "double", "reason": "string", "b_adds": "string", "relation": "string", "direction": "string"},
    {"outcome": OUTCOMES, "relation": RELATIONS, "direction": DIRECTIONS}, ("confidence", "reason", "b_adds", "relation", "direction"),
)
REGENERATE = Step(
    "regenerate", "1",
    "You write one note out of two that overlap. Keep all that either says, say nothing twice, add nothing of your own, and keep the examples as they stand. Report what changed.",
    {"body_md": "string", "changelog": "string"},
)
TIEBREAK = Step("tiebreak", "1", "Rules and word lists disagree about the level of a note. Choose the level at which learners first need it.", {"cefr": "string", "reason": "string"}, {"cefr": LEVELS}, ("reason",))
TRANSPARENCY = Step(
    "transparency", "1", "Judge a family of words that share a root: can a learner tell the meaning of its members from root and prefix?", {"transparency": "string", "reason": "string", "confidence": "double"}, {"transparency": TRANSPARENCIES}, ("reason", "confidence"),
)
TRANSCRIBE = Step("transcribe", "1", "Transcribe the text of the image, line by line, without comments of your own.")
STEPS = {s.name: s for s in (EXTRACT, ADJUDICATE, REGENERATE, TIEBREAK, TRANSPARENCY, TRANSCRIBE)}


def render(label: str, title_de: Column, title_en: Column, type_: Column, cefr: Column, body: Column) -> Column:
    """A node as a prompt shows it."""
    head = F.concat(F.lit(f"{label}: "), F.coalesce(title_de, F.lit("")), F.lit(" ("), F.coalesce(title_en, F.lit("")), F.lit(")\ntype: "), F.coalesce(type_, F.lit("")), F.lit(" | cefr: "), F.coalesce(cefr, F.lit("")))
    return F.concat(head, F.lit("\n\n"), T.strip(F.coalesce(body, F.lit(""))))


def pair_text(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("\n\n---\n\n"), b)


def run(rows: DataFrame, step: Step, variable: Column, client: models.Client, model: str, cache: DataFrame | None = None, cap: int = 3, shots: list[tuple[str, str]] | None = None) -> DataFrame:
    """``rows`` with ``key, answer, finish_reason, cached, value, error, attempts``; columns of ``rows`` named so are an error.

    Rows with the same prompt have the same key, and are asked once. Only what varies is
    shuffled: the fixed parts, mostly longer, are put around it where it is asked.
    """
    made = ["prompt", "key", "answer", "finish_reason", "cached", "value", "error", "attempts"]
    if clash := set(made) & set(rows.columns):
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    asked = rows.withColumn("prompt", variable)
    asked = asked.withColumn("key", models.prompt_key(step.name, model, step.version, step.prompt(F.col("prompt"), shots)))
    once = asked.groupBy("key").agg(F.first("prompt").alias("prompt")).withColumn("prompt", step.prompt(F.col("prompt"), shots))
    told = models.ask_until(once, "prompt", client, step.check, cap, cache, keep_prompts=False)
    return asked.drop("prompt").join(grown(told.drop("prompt")), "key").select(*rows.columns, *made[1:])


def regenerated(rows: DataFrame, client: models.Client, model: str, cache: DataFrame | None = None, cap: int = 3) -> DataFrame:
    """``candidate, other, body_md, changelog, unsourced`` of pairs ``candidate, other, a, b, b_adds, sources``.

    ``a`` and ``b`` are the rendered sides, ``sources`` all texts behind them. A new body with an
    example that none of them has is flagged, not refused.
    """
    adds = F.when(F.coalesce("b_adds", F.lit("")) != "", F.concat(F.lit("\n\nB adds: "), "b_adds")).otherwise(F.lit(""))
    out = run(rows, REGENERATE, F.concat(pair_text(F.col("a"), F.col("b")), adds), client, model, cache, cap).where("error is null")
    return out.select("candidate", "other", "value.body_md", "value.changelog", (F.size(merge.unsourced_examples(F.col("value.body_md"), F.col("sources"))) > 0).alias("unsourced"))
