"""Levels and morphology on worked cases."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import level, morph

NODE = "id string, title_de string, body_md string, cefr string, cefr_basis string, lemmas array<string>"
LISTS = [("waschen", "A1"), ("haus", "A1"), ("trinken", "A1"), ("bitten", "A2"), ("helfen", "A2"), ("abwaschen", "B1"), ("waschen", "B1")]


@pytest.mark.parametrize(
    ("title", "body", "lemmas", "cefr", "basis", "want"),
    [
        ("Wechselpräpositionen", "", None, "B1", "llm:extraction", ("A2", "grammar:wechselpräposition(A2)")),
        ("Haus", "", None, "B1", "llm:extraction", ("A1", "goethe:a1(haus)")),
        ("Wechselpräposition", "", ["helfen"], "B1", None, ("A2", "grammar:wechselpräposition(A2); goethe:a2(helfen)")),
        ("Bitten", "Konjunktiv II hier", None, "B1", None, (None, "unresolved")),
        ("Etwas", "mit Konjunktiv II", None, "B1", None, ("B1", "grammar:konjunktiv-ii(B1,body)")),
        ("Etwas", "mit Konjunktiv II", None, "C1", None, (None, "unresolved")),
        ("Etwas", "nichts", None, "A2", None, ("A2", "human:seed")),
        ("Etwas", "nichts", None, "A2", "llm:extraction", (None, "unresolved")),
        ("Familie", "", ["waschen", "abwaschen"], "A2", None, ("B1", "goethe:b1(abwaschen)")),
        ("Konjunktiv I", "", None, "A2", None, ("C1", "grammar:konjunktiv-i(C1)")),
        ("Plusquamperfekt", "", None, "A2", None, ("A2", "human:seed")),
        ("PRÄSENS", "", None, "A2", None, ("A1", "grammar:präsens(A1)")),
    ],
)
def test_levels(spark, title, body, lemmas, cefr, basis, want):
    words = level.word_levels(spark.createDataFrame(LISTS, "lemma string, level string"))
    nodes = spark.createDataFrame([("n", title, body, cefr, basis, lemmas)], NODE)
    row = level.levels(nodes, words).first()
    assert (row.derived, row.derived_basis) == want


def test_prefix_classes(spark):
    df = spark.createDataFrame([(p,) for p in ("an", "ver", "um", "xyz")], "p string")
    assert [r[0] for r in df.select(morph.classify(F.col("p"))).collect()] == ["separable", "inseparable", "variable", None]


CORPUS = """seq long, id string, title_de string, type string, cefr string, separable boolean, root string,
  family_transparency string, lemmas array<string>, links array<struct<target:string,relation:string,confidence:double>>"""


def corpus(spark):
    rows = [
        (0, "familie-waschen", "Familie waschen", "vocab", "A2", None, "waschen", "high", ["waschen", "abwaschen", "aufwaschen", "umwaschen", "sich waschen"], []),
        (1, "prefix-an", "an- (Präfix)", "pattern", "A2", True, None, None, None, [("ankommen", "same_family", None), ("anmachen", "same_family", None), ("um-hilfe", "governs", None)]),
        (2, "prefix-ab", "ab- (Präfix)", "pattern", "A2", True, None, None, None, []),
        (3, "familie-derived", "x", "vocab", "B1", None, "abwaschen", None, [], []),
    ]
    return spark.createDataFrame(rows, CORPUS)


def test_segment(spark):
    known = morph.stems(corpus(spark))
    words = spark.createDataFrame([("abwaschen", None), ("umwaschen", None), ("umwaschen", True), ("vorbeikommen", None), ("xy", None), ("verstehen", None)], "word string, declared boolean")
    got = {(r.word, r.declared): (r.status, r.prefix, r.separability) for r in morph.segment(words, known).collect()}
    assert got["abwaschen", None] == ("segmented", "ab", "separable")
    assert got["umwaschen", None] == ("variable-stress", "um", None)
    assert got["umwaschen", True] == ("segmented", "um", "separable")
    assert got["vorbeikommen", None] == ("no-corpus-evidence", "vorbei", None)
    assert got["xy", None] == ("no-prefix", None, None)
    assert got["verstehen", None][0] == "no-corpus-evidence"


def test_grid(spark):
    got = {(r.prefix, r.root): r.state for r in morph.grid(corpus(spark)).collect()}
    # the family of a derived verb is no column; links of prefix nodes imply columns
    assert set(got) == {(p, r) for p in ("an", "ab") for r in ("waschen", "kommen", "machen")}
    assert got["ab", "waschen"] == "learned"
    assert got["an", "kommen"] == got["an", "machen"] == "identified"
    assert got["ab", "kommen"] == "gap"


def test_families(spark):
    links, creates, withheld = morph.families(corpus(spark))
    assert {(r.candidate, r.counterpart) for r in links.collect()} == {("familie-waschen", "prefix-ab"), ("familie-waschen", "prefix-auf")}
    assert [(r.id, r.cefr, r.members) for r in creates.collect()] == [("prefix-auf", "A2", ["aufwaschen"])]
    assert {(r.word, r.status) for r in withheld.collect()} == {("umwaschen", "variable-stress")}
