"""Model steps that ask again, and caches with broken entries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwright.operators import models
from loomwright.sources import files


def check(answer, reason):
    return models.parse(answer, reason, {"n": "long"})


def test_only_refused_rows_are_asked_again(spark, tmp_path):
    log = str(tmp_path / "calls")
    Path(log).mkdir()

    def client(prompts):
        import uuid

        out = []
        for p in prompts:
            Path(log, uuid.uuid4().hex).write_text(p)
            k = int(p.split()[0])
            out.append((f'{{"n": {k}}}', "stop") if p.count("refused") >= k else ("", "stop"))
        return out

    rows = spark.createDataFrame([(k, f"{k} please", f"key{k}", "own") for k in range(5)], "id int, prompt string, key string, extra string")
    out = models.ask_until(rows, "prompt", client, check, cap=3)
    got = {r.id: (r.attempts, r.value.n if r.value else None, r.error, r.extra) for r in out.collect()}
    assert got == {0: (1, 0, None, "own"), 1: (2, 1, None, "own"), 2: (3, 2, None, "own"), 3: (3, None, "empty", "own"), 4: (3, None, "empty", "own")}
    out.collect()  # reading the result again calls nobody
    calls = [p.read_text() for p in Path(log).iterdir()]
    assert len(calls) == 5 + 4 + 3 and sum("empty" in c for c in calls) == 7
    # a cached answer that is good is not asked, one that is refused is
    cache = spark.createDataFrame([("key1", '{"n": 9}', "stop"), ("key2", "cut", "length")], "key string, answer string, finish_reason string")
    out = models.ask_until(rows.where("id in (1, 2)"), "prompt", client, check, cap=3, cache=cache)
    assert {r.id: (r.attempts, r.cached, r.value.n) for r in out.collect()} == {1: (1, True, 9), 2: (3, False, 2)}
    assert len(list(Path(log).iterdir())) == 12 + 2
    assert models.ask_until(rows.limit(0), "prompt", client, check).count() == 0
    with pytest.raises(Exception, match="no such client"):
        models.ask_until(rows, "prompt", lambda prompts: (_ for _ in ()).throw(RuntimeError("no such client")), check)


def test_broken_entries_are_told_and_set_aside(spark, tmp_path):
    lines = ['{"key": "a", "embedding": [1.0, 2.0]}', '{"key": "b", "embedding": [1.0', "not json", '{"key": "c"}', '{"key": "d", "embedding": [1.0]}', "", '{"key": null, "embedding": [1.0, 2.0]}', '{"key": "e", "embedding": "text"}']
    (tmp_path / "cache.json").write_text("\n".join(lines))
    good, broken = files.read_cache(spark, str(tmp_path / "cache.json"), "key string, embedding array<double>", ("embedding",), valid=F.size("embedding") == 2)
    assert [r.key for r in good.collect()] == ["a"] and good.columns == ["key", "embedding"]
    assert sorted((r.line, r.defect) for r in broken.collect()) == sorted([(lines[1], "unreadable"), (lines[2], "unreadable"), (lines[3], "incomplete"), (lines[4], "invalid"), (lines[6], "incomplete"), (lines[7], "unreadable")])


def test_every_step_checks_its_answers(spark):
    from loomwright.operators import steps

    note = '{"title_de": "T", "title_en": "t", "type": "vocab", "cefr": "B1", "cefr_basis": null, "register": [], "themes": [], "body_md": "b", "confidence": 0.5}'
    cases = [
        ("extract", f'{{"candidates": [{note}]}}', "stop", None), ("extract", '{"candidates": []}', "stop", None), ("extract", f'{{"candidates": [{note.replace("B1", "B9")}]}}', "stop", "bad-candidate"), ("extract", "{}", "stop", "missing-key"),
        ("extract", f'{{"candidates": [{note}', "length", "truncated"), ("adjudicate", '{"outcome": "SAME"}', "stop", None), ("adjudicate", '{"outcome": "MAYBE"}', "stop", "bad-outcome"), ("adjudicate", '{"outcome": "DISTINCT_RELATED", "relation": "governs"}', "stop", "incoherent"),
        ("adjudicate", '{"outcome": "SAME", "extra": 1}', "stop", "unknown-key"), ("regenerate", '{"body_md": " ", "changelog": ""}', "stop", "empty-body"), ("regenerate", '```json\n{"body_md": "x", "changelog": ""}\n```', "stop", None), ("tiebreak", '{"cefr": "B3"}', "stop", "bad-cefr"),
        ("tiebreak", '{"cefr": "B2"}', "stop", None), ("transparency", '{"transparency": "drifted"}', "stop", None), ("transparency", "", "stop", "empty"), ("transcribe", "Zeile\n", "stop", None), ("transcribe", "half", "length", "truncated"), ("transcribe", " ", "stop", "empty"), ("transcribe", None, None, "empty"),
    ]
    for name in steps.STEPS:
        rows = [(k, a, r) for k, (n, a, r, _) in enumerate(cases) if n == name]
        value, error = steps.STEPS[name].check(F.col("a"), F.col("r"))
        for r in spark.createDataFrame(rows, "k int, a string, r string").select("k", value.alias("v"), error.alias("e")).collect():
            assert r.e == cases[r.k][3] and (r.v is None) == (r.e is not None), cases[r.k]
    # a stray relation of texts that are the same is dropped
    value, _ = steps.ADJUDICATE.check(F.lit('{"outcome": "SAME", "relation": "governs", "direction": "a_to_b"}'), F.lit("stop"))
    assert spark.range(1).select(value.alias("v")).first().v.relation is None


def test_same_prompts_are_asked_once(spark, tmp_path):
    from loomwright.operators import steps

    log = tmp_path / "calls"
    log.mkdir()

    def client(prompts):
        import uuid

        for p in prompts:
            Path(str(log), uuid.uuid4().hex).write_text(p)
        return [('{"cefr": "A1"}', "stop")] * len(prompts)

    rows = spark.createDataFrame([(k, "same" if k < 5 else f"other {k}") for k in range(8)], "k int, body string")
    out = steps.run(rows, steps.TIEBREAK, F.col("body"), client, "m")
    assert [r.value.cefr for r in out.collect()] == ["A1"] * 8 and len(list(log.iterdir())) == 4
    with pytest.raises(ValueError, match="like results"):
        steps.run(rows.withColumn("value", F.lit(1)), steps.TIEBREAK, F.col("body"), client, "m")


def test_settings_are_checked(spark, tmp_path):
    from loomwright.sources import settings

    path = tmp_path / "models.yaml"
    path.write_text("providers:\n  z: {kind: api, base_url: u, api_key_env: K}\n  own: {kind: local}\npricing: {z: {m: {}}}\ndefaults: {provider: z, model: m}\nsteps:\n  merge: {model: big, fallback: {provider: own, model: small}}\n")
    got = settings.read_settings(spark, str(path))
    assert models.resolve(got, "merge") == {"provider": "z", "model": "big", "temperature": None, "max_tokens": None}
    assert models.resolve(got, "merge", use_fallback=True)["model"] == "small" and models.resolve(got, "merge", {"model": "arg"}, {"MERGE_MODEL": "env"}, True)["model"] == "arg"
    for wrong, why in (({"models": {}}, "sections"), ({"providers": {"z": {"kind": "api"}}}, "address|base_url"), ({"defaults": {"provider": "q"}}, "unknown provider"), ({"providers": {}, "steps": {"s": {"fallback": {"provider": "q"}}}}, "fallback"), ({"pricing": {"q": {}}}, "pricing")):
        with pytest.raises(ValueError, match=why):
            settings.check_settings(wrong)
    assert settings.folder("X_DIR", "/d", {}) == "/d" and settings.folder("X_DIR", "/d", {"X_DIR": "/e"}) == "/e"
