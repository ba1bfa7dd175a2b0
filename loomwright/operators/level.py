"""Difficulty levels from rules: grammar structures in texts, word lists, and the decision table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.schemas import LEVELS


@dataclass(frozen=True)
class Rule:
    """A structure, its level, and a pattern over folded text (``\\b`` as Unicode has it)."""

    structure: str
    level: str
    pattern: str


# The syllabus map as it is published.
GRAMMAR = [
    Rule("präsens", "A1", r"\bpräsens"),
    Rule("nominativ", "A1", r"\bnominativ"),
    Rule("perfekt", "A2", r"\bperfekt"),
    Rule("akkusativ", "A2", r"\bakkusativ"),
    Rule("wechselpräposition", "A2", r"\bwechselpräposition"),
    Rule("passiv", "B1", r"\bpassiv"),
    Rule("konjunktiv-ii", "B1", r"\bkonjunktiv[\s-]*(?:ii|2)\b"),
    Rule("relativsatz", "B1", r"\brelativsa|\brelativsä"),
    Rule("genitiv", "B2", r"\bgenitiv"),
    Rule("erweiterter-infinitiv", "B2", r"\berweiterte[rn]?\s+infinitiv"),
    Rule("partizipialattribut", "C1", r"\bpartizipialattribut"),
    Rule("nominalstil", "C1", r"\bnominalstil"),
    Rule("konjunktiv-i", "C1", r"\bkonjunktiv[\s-]*(?:i(?!i)|1)\b"),
]
HUMAN_BASIS, PLACEHOLDERS = "human:seed", ("llm:",)


def level_order(level: Column) -> Column:
    """0 for A1 to 5 for C2; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)).cast("int") - 1


def level_name(order: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), order)


def grammar_hits(text: Column, where: str, rules: list[Rule] = GRAMMAR, form: T.Form = T.plain) -> Column:
    """All structures in a text: ``array<struct<structure, level, place>>``. No join: the rules are few."""
    def hits(folded: Column) -> Column:
        return F.array_compact(F.array(*(F.when(folded.rlike("(?U)" + r.pattern), F.struct(F.lit(r.structure).alias("structure"), F.lit(LEVELS.index(r.level)).alias("level"), F.lit(where).alias("place"))) for r in rules)))

    # a text is folded once, not for each rule
    return T.let(T.fold_open(form(text)), hits)


def strongest(title_hits: Column, body_hits: Column) -> Column:
    """``struct<level, place, structures>`` of the hits that set the level: any title hit shadows the body's; null without hits."""
    def pick(title: Column, scoped: Column) -> Column:
        top = F.array_max(F.transform(scoped, lambda h: h["level"]))
        names = F.array_sort(F.array_distinct(F.transform(F.filter(scoped, lambda h: h["level"] == top), lambda h: h["structure"])))
        return F.when(F.size(scoped) > 0, F.struct(top.alias("level"), F.when(F.size(title) > 0, "title").otherwise("body").alias("place"), names.alias("structures")))

    # each list of hits is made once: its patterns read whole texts
    return T.let(title_hits, lambda title: T.let(F.when(F.size(title) > 0, title).otherwise(body_hits), lambda scoped: pick(title, scoped)))


def word_levels(lists: DataFrame) -> DataFrame:
    """``lemma, level, source``: each word at the lowest level that lists it. Input: ``lemma, level``."""
    folded = lists.select(T.fold(F.col("lemma")).alias("lemma"), level_order(F.col("level")).alias("level")).where("lemma <> ''")
    return folded.groupBy("lemma").agg(F.min("level").alias("level")).withColumn("source", F.concat(F.lit("goethe:"), F.lower(level_name(F.col("level")))))


def lexical_anchor(nodes: DataFrame, words: DataFrame, form: T.Form = T.plain) -> DataFrame:
    """``id, lex``: the highest level among a node's lemmas, else its title's; null if nothing is listed.

    ``words`` is a word list: it is bounded by the language, and Spark checks its size before
    it broadcasts it.
    """
    return nodes.select("id").join(_listed(nodes, words, form), "id", "left")


def _listed(nodes: DataFrame, words: DataFrame, form: T.Form) -> DataFrame:
    """``id, lex`` of nodes that have a listed word."""
    # as a file its size is known beforehand; else all words of all nodes are shuffled to find out
    words = written(words, "words")
    # each word once, in the order in which it comes first
    lemmas = nodes.select("id", F.posexplode(F.array_distinct(F.coalesce("lemmas", F.array().cast("array<string>")))).alias("at", "word"))
    titles = nodes.select("id", F.lit(1_000_000_000).alias("at"), F.col("title_de").alias("word"))
    asked = lemmas.unionByName(titles).withColumn("lemma", T.fold(F.col("word"), form)).join(words, "lemma")
    # lemmas before the title; among lemmas the highest level, the first of equals
    rank = F.struct((F.col("at") == 1_000_000_000).cast("int").alias("title"), (-F.col("level")).alias("level"), "at")
    return asked.groupBy("id").agg(F.min_by(F.struct("lemma", "level", "source"), rank).alias("lex"))


def is_absent(basis: Column) -> Column:
    return basis.isNull() | (T.strip(basis) == "")


def is_placeholder(basis: Column, prefixes: tuple[str, ...] = PLACEHOLDERS) -> Column:
    return is_absent(basis) | reduce(lambda a, b: a | b, (T.strip(basis).startswith(p) for p in prefixes))


def grammar_basis(decided: Column) -> Column:
    return F.concat(F.lit("grammar:"), F.array_join(decided["structures"], "+"), F.lit("("), level_name(decided["level"]), F.when(decided["place"] == "title", "").otherwise(",body"), F.lit(")"))


def lexical_basis(lex: Column) -> Column:
    return F.concat(lex["source"], F.lit("("), lex["lemma"], F.lit(")"))


def derive(decided: Column, lex: Column, current: Column, basis: Column) -> tuple[Column, Column]:
    """``(level name, basis)``; a null level means that rules cannot tell.

    The rules in order: a structure named in the title stands if the word lists agree or are
    silent; one of the body only if the lists agree, or nothing speaks against the present
    level; a listed word alone decides; with no signal a level without any basis is a person's.
    """
    title = decided["place"] == "title"
    silent = lex.isNull()
    agrees = F.coalesce(lex["level"] == decided["level"], F.lit(False))
    g, x = grammar_basis(decided), lexical_basis(lex)
    cases = [
        (decided.isNotNull() & title & silent, level_name(decided["level"]), g),
        (decided.isNotNull() & title & agrees, level_name(decided["level"]), F.concat_ws("; ", g, x)),
        (decided.isNotNull() & ~title & agrees, level_name(decided["level"]), F.concat_ws("; ", x, g)),
        (decided.isNotNull() & ~title & silent & (level_order(current) == decided["level"]), level_name(decided["level"]), g),
        (decided.isNull() & ~silent, level_name(lex["level"]), x),
        (decided.isNull() & silent & is_absent(basis), current, F.lit(HUMAN_BASIS)),
    ]
    level, why = F.lit(None).cast("string"), F.lit("unresolved")
    for when, then, because in reversed(cases):
        hit = F.coalesce(when, F.lit(False))
        level, why = F.when(hit, then).otherwise(level), F.when(hit, because).otherwise(why)
    return level, why


def levels(nodes: DataFrame, words: DataFrame, rules: list[Rule] = GRAMMAR, form: T.Form = T.plain, keep: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` columns ``id, cefr, cefr_basis`` and those of ``keep``, with ``derived`` and ``derived_basis``."""
    rows = nodes.withColumn("decided", strongest(grammar_hits(F.col("title_de"), "title", rules, form), grammar_hits(F.col("body_md"), "body", rules, form)))
    rows = rows.join(_listed(nodes, words, form), "id", "left")
    level, why = derive(F.col("decided"), F.col("lex"), F.col("cefr"), F.col("cefr_basis"))
    return rows.select("id", "cefr", "cefr_basis", *keep, level.alias("derived"), why.alias("derived_basis"))


def relevel(nodes: DataFrame, words: DataFrame, rules: list[Rule] = GRAMMAR, everything: bool = False) -> DataFrame:
    """Level changes to propose: nodes whose basis needs deriving (or all) and whose result differs."""
    aim = nodes if everything else nodes.where(is_placeholder(F.col("cefr_basis")))
    out = levels(aim, words, rules).where("derived is not null")
    changed = ~(F.col("derived").eqNullSafe(F.col("cefr")) & F.col("derived_basis").eqNullSafe(F.col("cefr_basis")))
    out = out.where(changed)
    return out.select(T.proposal_id(F.lit("relevel"), F.col("id")).alias("proposal_id"), F.col("id").alias("candidate"), F.col("derived").alias("cefr"), F.col("derived_basis").alias("cefr_basis"))
