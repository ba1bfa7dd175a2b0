"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Documents fall into cells (source, language, topic). Iterative proportional fitting scales the
token weights of the cells to the target share of each source, language and topic in turn,
until all three marginals hold. A cell's gain is its fitted weight over its present weight; a
document's sampling probability is its cell's gain over the largest gain, so the expected
tokens of the sample have the fitted shares. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.shared import written

#: Rounds of fitting.
ROUNDS = 60
WORD = r"[^\x09\x0A\x0D\x20]+"
OTHER = "*"


def n_tokens(text: Column) -> Column:
    """Tokens of a text: its runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _category(value: Column, targets: dict[str, float]) -> Column:
    """Place of a value among the target's names; unnamed and null values share the last place."""
    names = [n for n in targets if n != OTHER]
    place = F.array_position(F.array(*map(F.lit, names)), value) if names else F.lit(None).cast("long")
    return F.when(place > 0, place.cast("int") - 1).otherwise(F.lit(len(names)))


def _shares(targets: dict[str, float]) -> list[float]:
    if any(v < 0 for v in targets.values()) or not sum(targets.values()):
        raise ValueError("target weights must be non-negative and not all zero")
    return [float(v) for n, v in targets.items() if n != OTHER] + [float(targets.get(OTHER, 0.0))]


def _fit(dims: list[list[float]], rounds: int) -> str:
    """Expression over ``cells array<struct<at array<int>, t double>>``: fitted weights in order."""
    step = "w"
    for d, shares in enumerate(dims):
        goal = f"array({', '.join(f'{x!r}D' for x in shares)})"
        # sums by category, then each weight times goal over sum; goals of absent categories drop out
        step = f"""transform(array({step}), w -> transform(array(
              transform(sequence(0, {len(shares) - 1}), c -> aggregate(arrays_zip(cells, w), 0D, (s, x) -> s + if(x.cells.at[{d}] = c, x.w, 0D)))), sums ->
              transform(array(aggregate(sequence(0, {len(shares) - 1}), 0D, (s, c) -> s + if(sums[c] > 0D, {goal}[c], 0D))), total ->
                transform(cells, (x, i) -> if(sums[x.at[{d}]] > 0D and total > 0D, w[i] * {goal}[x.at[{d}]] / total / sums[x.at[{d}]], 0D)))[0])[0])[0]"""
    return f"aggregate(sequence(1, {rounds}), transform(cells, x -> x.t), (w, round) -> {step})"


def calibrate(docs: DataFrame, source: Column, lang: Column, topic: Column, tokens: Column, targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> DataFrame:
    """``s, l, t, gain`` for each cell that has tokens, at most one for each combination of named categories.

    ``targets`` has ``source``, ``lang`` and ``topic``: wanted weights by name, scaled to 1 over
    the categories present; ``"*"`` is the weight of all unnamed values and nulls together. The
    cells' number is bounded by the targets, not by the data. No tokens give no cells.
    """
    dims = [_shares(targets[k]) for k in ("source", "lang", "topic")]
    cells = docs.select(_category(source, targets["source"]).alias("s"), _category(lang, targets["lang"]).alias("l"), _category(topic, targets["topic"]).alias("t"), tokens.alias("n"))
    cells = written(cells.groupBy("s", "l", "t").agg(F.sum("n").cast("double").alias("n")).where("n > 0"), "cells")
    one = cells.agg(F.array_sort(F.collect_list(F.struct(F.array("s", "l", "t").alias("at"), F.col("n").alias("t")))).alias("cells"))
    # written, so that no later expression repeats the fitting
    one = written(one.where(F.size("cells") > 0).withColumn("w", F.expr(_fit(dims, rounds))), "weights")
    scale = "aggregate(cells, 0D, (s, x) -> s + x.t) / aggregate(w, 0D, (s, x) -> s + x)"
    one = one.select(F.expr(f"transform(array({scale}), k -> transform(cells, (x, i) -> named_struct('at', x.at, 'gain', w[i] / x.t * k)))[0]").alias("fit"))
    fit = one.select(F.explode("fit").alias("x")).select(F.expr("x.at[0]").alias("s"), F.expr("x.at[1]").alias("l"), F.expr("x.at[2]").alias("t"), F.col("x.gain").alias("gain"))
    return written(fit, "fit")


def chance(id_: Column, seed: int) -> Column:
    """A number in [0, 1) from the id alone: the same on every run; null ids count as empty."""
    text = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], topic: Column, tokens: Column, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", seed: int = 7) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_topic``, ``mix_gain``, ``mix_probability`` and ``mix_selected``.

    Every document of the input has a row. A document without tokens (null or blank text) is
    in no cell: gain and probability are 0. Rows of one id share their draw; ties cannot occur,
    as each id draws by itself; columns of ``docs`` named like results are an error; no rows
    give no rows.
    """
    own = ["mix_tokens", "mix_topic", "mix_gain", "mix_probability", "mix_selected"]
    clash = {*own, "__s", "__l", "__t", "__top", "__gain"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    rows = docs.withColumn("mix_tokens", tokens)
    rows = rows.withColumn("mix_topic", topic)
    fit = calibrate(rows, F.col(source_col), F.col(lang_col), F.col("mix_topic"), F.col("mix_tokens"), targets)
    top = fit.agg(F.max("gain").alias("__top"))
    named = fit.crossJoin(F.broadcast(top)).select(F.col("s").alias("__s"), F.col("l").alias("__l"), F.col("t").alias("__t"), F.col("gain").alias("__gain"), "__top")
    rows = rows.withColumns({"__s": _category(F.col(source_col), targets["source"]), "__l": _category(F.col(lang_col), targets["lang"]), "__t": _category(F.col("mix_topic"), targets["topic"])})
    # the cells are bounded by the targets, so they are broadcast
    rows = rows.join(F.broadcast(named), ["__s", "__l", "__t"], "left")
    filled = F.when(F.col("mix_tokens") > 0, F.coalesce("__gain", F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("mix_gain", filled).withColumn("mix_probability", F.when(filled > 0, filled / F.col("__top")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("mix_selected", chance(F.col(id_col), seed) < F.col("mix_probability"))
    return rows.select(*docs.columns, *own)
