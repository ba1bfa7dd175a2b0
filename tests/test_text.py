"""Text functions on worked cases."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.canonical import cache_key, canonical_json


def apply(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*(F.col(f"c{k}") for k in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.normalize_for_hash, "  Collapsed   \n Whitespace ", "collapsed whitespace"),
        (lambda x: T.normalize_for_hash(x, T.nfkc), "ﬁnden", "finden"),
        (T.fold, " Straße ", "strasse"),
        (T.norm_tag, "  All  Tag ", "all tag"),
        (T.fold_words, "**Ja**, das — geht!", "ja das geht"),
        (T.slugify, "Straße", "strasse"),
        (T.slugify, "Übung 3", "uebung-3"),
        (T.slugify, "Café Notes!", "cafe-notes"),
        (lambda x: T.slugify(x, form=T.nfkd_bare), "Ĉapo ǖ", "capo-u"),
        (T.slugify, "---", "quelle"),
        (T.node_slug, "Straße & Verkehr", "straße-verkehr"),
        (T.node_slug, "!!!", "konzept"),
        (lambda x: T.node_slug(x, form=T.nfc), "ä", "ä"),
        (T.lemma_key, "Die Wäsche", "wäsche"),
        (T.lemma_key, "sich waschen", "waschen"),
        (T.strip_markdown, "# Kopf\n- **fett** und *kursiv* `x` [alltag]\n|a|b|\n|---|\n---\nText", "fett und kursiv x Text"),
        (lambda x: T.embed_text(F.lit("Titel"), x), "", "query: Titel"),
        (lambda x: T.embed_text(F.lit("Titel"), x), "## E\n- Ja.", "query: Titel. Ja."),
        (T.strip_fences, "```json\n{}\n```", "{}"),
        (T.strip_fences, "```", ""),
        (T.strip_fences, " x ", "x"),
        (T.redact_data_uri, "data:image/png;base64,YWJj", "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
    ],
)
def test_scalar(spark, f, given, want):
    assert apply(spark, f, given) == want


def test_shingles_and_jaccard(spark):
    assert apply(spark, T.shingles, "abcdefg") == ["abcde", "bcdef", "cdefg"]
    assert apply(spark, T.shingles, "abc") == ["abc"]
    assert apply(spark, T.shingles, "") == []
    assert apply(spark, T.shingles, "a😀bcdeé") == ["a😀bcd", "😀bcde", "bcdeé"]
    for a, b, want in (("abcdef", "abcdeg", 1 / 3), ("", "", 1.0), ("abc", "", 0.0)):
        assert apply(spark, lambda x, y: T.jaccard(T.shingles(x), T.shingles(y)), a, b) == pytest.approx(want)


def test_examples(spark):
    body = "- no\n## Examples\n- Ich habe gearbeitet. (I worked.) [alltag]\ntext\n* Zwei\n## Notes\n- out\n### Beispiele\n- Drei [x]"
    assert apply(spark, T.example_lines, body) == ["Ich habe gearbeitet.", "Zwei", "Drei"]


def test_canonical_key(spark):
    assert canonical_json({"b": "ü", "a": None}) == '{"a":null,"b":"ü"}'
    one, other = (apply(spark, cache_key, x) for x in ('{"a": 1, "b": 2}', '{"b":2,"a":1}'))
    assert one == other


def test_batches_of_long_texts_are_small(spark):
    """However many rows a session lets into a batch, a difference of bodies and a model step get few long texts at a time."""
    from loomwright.functions import display
    from loomwright.operators import models

    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    rows = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("first\n"), F.repeat(F.lit("x"), 20_000)).alias("text"))
    client = lambda prompts: [(str(len(prompts)), "stop")] * len(prompts)
    most = models.ask(rows, "text", client).agg(F.max(F.col("answer").cast("int"))).first()[0]
    assert most < 500
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows.limit(5).select(display.body_diff(F.col("text"), F.lit("last")).alias("d")).where("size(d) > 0").count() == 5
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_set_sizes_of_odd_texts(spark):
    from loomwright.operators import dedup

    texts = [None, "", "a", "abcde", "abcdef", "x" * 30, "Ä\U0001f600b  CD\U0001f600ä", "abcabcabcabc"]
    got = {r.id: r.n_shingles for r in dedup.shingle_sizes(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    bare = [t and " ".join(t.lower().split()) for t in texts]
    assert got == {k: None if t is None else len({t[i : i + 5] for i in range(max(1, len(t) - 4))}) if t else 0 for k, t in enumerate(bare)}
