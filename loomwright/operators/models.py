"""Model steps: prompts as message lists, cache first, an injected client, strict answers.

No client is built in. A client is a function from a list of prompts (JSON of messages) to a
list of answers ``(text, finish_reason)``; it runs in Arrow batches on cache misses only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.canonical import cache_key
from loomwright.functions.folders import written
from loomwright.functions.workers import bounded_batches

Client = Callable[[list[str]], list[tuple[str, str]]]
MESSAGE = "struct<role:string,content:string>"


def messages(system: Column, shots: list[tuple[str, str]], variable: Column, schema: str | None = None) -> Column:
    """``array<struct<role, content>>``: fixed parts first, what varies last."""
    head = system if schema is None else F.concat(system, F.lit("\n\n"), F.lit(schema))
    rows = [F.struct(F.lit("system").alias("role"), head.alias("content"))]
    for asked, answered in shots:
        rows += [F.struct(F.lit("user").alias("role"), F.lit(asked).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit(answered).alias("content"))]
    return F.array(*rows, F.struct(F.lit("user").alias("role"), variable.alias("content")))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Turns as ordered message lists, one row a conversation."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def prompt_key(step: str, model: str, version: str, prompt: Column) -> Column:
    return cache_key(F.to_json(F.struct(F.lit(step).alias("step"), F.lit(model).alias("model"), F.lit(version).alias("version"), prompt.alias("messages"))))


def ask(rows: DataFrame, prompt_col: str, client: Client, cache: DataFrame | None = None, key_col: str = "key") -> DataFrame:
    """``rows`` with ``answer``, ``finish_reason`` and ``cached``; the client sees misses only.

    ``cache`` has ``key, answer, finish_reason``. Write the result before using it twice, or
    the calls are made twice.
    """
    if cache is not None:
        held = rows.join(cache.select(key_col, "answer", "finish_reason").dropDuplicates([key_col]), key_col, "left")
        hits = held.where("answer is not null").withColumn("cached", F.lit(True))
        misses = held.where("answer is null").drop("answer", "finish_reason")
    else:
        hits, misses = None, rows
    bounded_batches(rows.sparkSession)
    names = misses.columns
    at = names.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = client(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in said], pa.string()), pa.array([f for _, f in said], pa.string())], names=[*names, "answer", "finish_reason"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema.fields)
    fresh = misses.mapInArrow(run, f"{schema}, answer string, finish_reason string").withColumn("cached", F.lit(False))
    return fresh if hits is None else hits.select(*fresh.columns).unionByName(fresh)


def ask_until(rows: DataFrame, prompt_col: str, client: Client, check: Callable[[Column, Column], tuple[Column, Column]], cap: int = 3, cache: DataFrame | None = None, key_col: str = "key", keep_prompts: bool = True) -> DataFrame:
    """``rows`` with ``answer, finish_reason, cached, value, error, attempts``: what ``check`` refuses is asked again, ``cap`` times at most.

    ``check`` gives ``(value, error)`` of an answer and its finish reason, as :func:`parse` does.
    Each round asks for the refused rows only, with the error added to their prompt, and is
    written, so no call is made twice. The cache answers first only; a cached answer that is
    refused is asked anew. After the last round a row keeps its last answer and error. Without
    ``keep_prompts`` those of accepted answers are null, as nobody needs them any more.
    """
    own, rounds = rows.columns, []
    open_ = rows
    for n in range(1, cap + 1):
        said = ask(open_, prompt_col, client, cache if n == 1 else None, key_col)
        value, error = check(F.col("answer"), F.col("finish_reason"))
        told = said.select(*said.columns, value.alias("value"), error.alias("error"), F.lit(n).alias("attempts"))
        if not keep_prompts:
            told = told.withColumn(prompt_col, F.when(F.col("error").isNotNull() & F.lit(n < cap), F.col(prompt_col)))
        told = written(told, f"asked{n}")
        refused = told.where("error is not null")
        if n == cap or refused.isEmpty():
            rounds.append(told)
            break
        rounds.append(told.where("error is null"))
        again = F.concat(prompt_col, F.lit("\n\nThe last answer was refused: "), F.col("error"), F.lit(". Answer again."))
        open_ = refused.withColumn(prompt_col, again).select(*own)
    return reduce(DataFrame.unionByName, rounds)


def parse(answer: Column, finish_reason: Column, fields: dict[str, str], enums: dict[str, tuple[str, ...]] | None = None, optional: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """``(value, error)`` of a JSON answer, checked in order: cut off, empty, not JSON, keys, enum values.

    Unknown and missing keys are errors, which ``from_json`` alone does not tell.
    """
    bare = T.strip_fences(F.coalesce(answer, F.lit("")))
    schema = ", ".join(f"{k} {v}" for k, v in fields.items())
    value = F.from_json(bare, schema)
    keys = F.json_object_keys(bare)
    need = F.array(*(F.lit(k) for k in fields if k not in optional))
    allowed = F.array(*map(F.lit, fields))
    error = F.when(finish_reason == "length", "truncated").when(bare == "", "empty").when(keys.isNull(), "not-json")
    error = error.when(F.size(F.array_except(keys, allowed)) > 0, "unknown-key").when(F.size(F.array_except(need, keys)) > 0, "missing-key")
    for name, values in (enums or {}).items():
        error = error.when(value[name].isNotNull() & ~value[name].isin(list(values)), f"bad-{name}")
    return F.when(error.isNull(), value), error


def coherent(verdict: Column) -> tuple[Column, Column, Column]:
    """``(relation, direction, error)``: related-but-distinct needs both, any other outcome has neither."""
    related = verdict["outcome"] == "DISTINCT_RELATED"
    lacks = related & (verdict["relation"].isNull() | verdict["direction"].isNull())
    return F.when(related, verdict["relation"]), F.when(related, verdict["direction"]), F.when(lacks, "incoherent")


def unpack_usage(response: Column) -> Column:
    """Token counts of a provider's JSON response; absent ones are 0."""
    def number(path: str) -> Column:
        return F.coalesce(F.get_json_object(response, path).cast("long"), F.lit(0))

    return F.struct(
        number("$.usage.prompt_tokens").alias("prompt_tokens"),
        number("$.usage.prompt_tokens_details.cached_tokens").alias("cached_prompt_tokens"),
        number("$.usage.completion_tokens").alias("completion_tokens"),
        number("$.usage.total_tokens").alias("total_tokens"),
    )


def resolve(settings: dict, step: str, given: dict | None = None, env: dict | None = None, use_fallback: bool = False) -> dict:
    """A step's provider and model: arguments, then environment, then (if asked for) the step's fallback, the step, defaults."""
    given, env = given or {}, env or {}
    row, base = settings.get("steps", {}).get(step, {}), settings.get("defaults", {})
    other = (row.get("fallback") or {}) if use_fallback else {}
    out = {}
    for k in ("provider", "model", "temperature", "max_tokens"):
        options = (given.get(k), env.get(f"{step}_{k}".upper()), other.get(k), row.get(k), base.get(k))
        out[k] = next((v for v in options if v is not None), None)
    if not out["provider"] or not out["model"]:
        raise ValueError(f"step {step!r} resolves to no provider or model")
    if out["provider"] not in settings.get("providers", {}):
        raise ValueError(f"step {step!r} names an unknown provider: {out['provider']}")
    return out
