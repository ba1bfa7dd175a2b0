"""Queries of levels and morphology; the invented prose of the tables stands in for German."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.folders import written
from loomwright.operators import level, morph
from loomwright.operators.level import Rule
from loomwright.operators.proposals import needs_human
from loomwright.plans.registry import FOLD, query, table

#: Rules over words that occur in the tables; the syllabus map is ``level.GRAMMAR``.
RULES = [Rule("artikel", "A1", r"\bder\b"), Rule("ung", "A2", r"\bung"), Rule("verben", "B1", r"\bver"), Rule("prep", "B2", r"\bof[\s-]*(?:the|a)\b"), Rule("schw", "C1", r"\bsch")]
WORDS = [("the", "A2"), ("the", "A1"), ("der", "A1"), ("on", "B1"), ("que", "B2"), ("le", "A1"), ("en", "C1")]

_B = r"(^|[^\p{L}\p{N}_])"
_E = r"([^\p{L}\p{N}_]|$)"
_RULES = [("artikel", 0, f"{_B}der{_E}"), ("ung", 1, f"{_B}ung"), ("verben", 2, f"{_B}ver"), ("prep", 3, rf"{_B}of[\s-]*(the|a){_E}"), ("schw", 4, f"{_B}sch")]
_NODES = "nodes AS (SELECT doc_id::VARCHAR AS id, string_split(text, chr(10))[1] AS title, text AS body, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'llm:extraction' END AS basis, ['A1','A2','B1','B2','C1','C2'][1 + (doc_id % 6)::INT] AS cefr, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS words FROM documents)"


def _hits(column: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(replace(lower({column}), 'ß', 'ss'), '{p}') THEN {{'s': '{s}', 'l': {k}}} END" for s, k, p in _RULES)
    return f"list_filter([{cases}], lambda h: h IS NOT NULL)"


_GRAMMAR = f"""hits AS (SELECT *, {_hits('title')} AS th, {_hits('body')} AS bh FROM nodes),
scoped AS (SELECT *, CASE WHEN len(th) > 0 THEN th ELSE bh END AS h, len(th) > 0 AS in_title FROM hits),
topped AS (SELECT *, list_max(list_transform(h, lambda x: x.l)) AS top FROM scoped),
decided AS (SELECT *, array_to_string(list_sort(list_transform(list_filter(h, lambda x: x.l = top), lambda x: x.s)), '+') AS names FROM topped)"""
_NAMES = "['A1','A2','B1','B2','C1','C2']"
_LEX = f"""lists AS (SELECT * FROM (VALUES ('the', 0), ('der', 0), ('on', 2), ('que', 3), ('le', 0), ('en', 4)) v(lemma, lv)),
asked AS (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM nodes),
lex AS (SELECT id, max_by(lemma, lv * 100000000 - pos) AS lemma, max(lv) AS lv FROM asked JOIN lists ON lemma = {FOLD.format('w')} GROUP BY id)"""


def _nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    level_of = F.get(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "C1", "C2"))), F.col("doc_id") % 6)
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title_de"),
        F.col("text").alias("body_md"),
        F.when(F.col("doc_id") % 3 != 0, "llm:extraction").alias("cefr_basis"),
        level_of.alias("cefr"),
        F.filter(F.split(F.lower("text"), " "), lambda w: w != "").alias("lemmas"),
    )


def _words(spark):
    return level.word_levels(spark.createDataFrame(WORDS, "lemma string, level string"))


@query(f"WITH {_NODES}, {_GRAMMAR} SELECT id, coalesce({_NAMES}[1 + top], '-') AS level, CASE WHEN top IS NULL THEN '-' WHEN in_title THEN 'title' ELSE 'body' END AS place, coalesce(names, '') AS names FROM decided")
def cefr_grammar(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    best = level.strongest(level.grammar_hits(F.col("title_de"), "title", RULES), level.grammar_hits(F.col("body_md"), "body", RULES))
    rows = nodes.select("id", best.alias("b"))
    return rows.select("id", F.coalesce(level.level_name(F.col("b.level")), F.lit("-")).alias("level"), F.coalesce("b.place", F.lit("-")).alias("place"), F.coalesce(F.array_join("b.structures", "+"), F.lit("")).alias("names"))


@query(f"WITH {_NODES}, {_LEX} SELECT id, lemma, {_NAMES}[1 + lv] AS level, 'goethe:' || lower({_NAMES}[1 + lv]) AS source FROM lex")
def cefr_lexical(spark, sf_dir):
    out = level.lexical_anchor(_nodes(spark, sf_dir), _words(spark)).where("lex is not null")
    return out.select("id", F.col("lex.lemma").alias("lemma"), level.level_name(F.col("lex.level")).alias("level"), F.col("lex.source").alias("source"))


_DERIVED = f"""{_NODES}, {_GRAMMAR}, {_LEX},
j AS (SELECT d.*, x.lemma, x.lv, 'grammar:' || names || '(' || {_NAMES}[1 + top] || CASE WHEN in_title THEN ')' ELSE ',body)' END AS g, 'goethe:' || lower({_NAMES}[1 + lv]) || '(' || lemma || ')' AS x FROM decided d LEFT JOIN lex x ON x.id = d.id),
r AS (SELECT id, cefr, basis, CASE
  WHEN top IS NOT NULL AND in_title AND (lv IS NULL OR lv = top) THEN {_NAMES}[1 + top]
  WHEN top IS NOT NULL AND NOT in_title AND (lv = top OR (lv IS NULL AND {_NAMES}[1 + top] = cefr)) THEN {_NAMES}[1 + top]
  WHEN top IS NULL AND lv IS NOT NULL THEN {_NAMES}[1 + lv]
  WHEN top IS NULL AND lv IS NULL AND basis IS NULL THEN cefr END AS derived,
 CASE WHEN top IS NOT NULL AND in_title AND lv IS NULL THEN g WHEN top IS NOT NULL AND in_title AND lv = top THEN g || '; ' || x
  WHEN top IS NOT NULL AND NOT in_title AND lv = top THEN x || '; ' || g WHEN top IS NOT NULL AND NOT in_title AND lv IS NULL AND {_NAMES}[1 + top] = cefr THEN g
  WHEN top IS NULL AND lv IS NOT NULL THEN x WHEN top IS NULL AND lv IS NULL AND basis IS NULL THEN 'human:seed' ELSE 'unresolved' END AS derived_basis FROM j)"""


@query(f"WITH {_DERIVED} SELECT id, cefr, coalesce(derived, '-') AS derived, derived_basis FROM r")
def derive_level(spark, sf_dir):
    out = level.levels(_nodes(spark, sf_dir), _words(spark), RULES)
    return out.select("id", "cefr", F.coalesce("derived", F.lit("-")).alias("derived"), "derived_basis")


@query(f"WITH {_DERIVED} SELECT 'relevel-' || id || '-' || substr(sha256('relevel|' || id || '||'), 1, 8) AS proposal_id, id AS candidate, derived AS cefr, derived_basis AS cefr_basis FROM r WHERE derived IS NOT NULL AND (derived <> cefr OR derived_basis IS DISTINCT FROM basis)")
def relevel_proposals(spark, sf_dir):
    return level.relevel(_nodes(spark, sf_dir), _words(spark), RULES)


_INVENTORY = ", ".join(f"('{p}', '{k}')" for p, k in sorted({**{p: "separable" for p in morph.SEPARABLE}, **{p: "inseparable" for p in morph.INSEPARABLE}, **{p: "variable" for p in morph.VARIABLE}}.items()))
_TOKENS = r"tokens AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents))"
_SPLITS = f"inv AS (SELECT * FROM (VALUES {_INVENTORY}) v(prefix, kind)), splits AS (SELECT word, prefix, substr(replace(word, 'ß', 'ss'), length(prefix) + 1) AS stem, kind FROM tokens JOIN inv ON starts_with(replace(word, 'ß', 'ss'), prefix) AND length(replace(word, 'ß', 'ss')) - length(prefix) >= 3)"


def _tokens(spark, sf_dir):
    """Distinct words of all texts; written, as most queries use them several times."""
    d = table(spark, sf_dir, "documents")
    return written(d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).distinct(), "tokens")


@query(f"WITH {_TOKENS}, {_SPLITS} SELECT word, prefix, stem, kind FROM splits")
def prefix_candidates(spark, sf_dir):
    return morph.prefix_candidates(_tokens(spark, sf_dir))


_KNOWN = f"known AS (SELECT {FOLD.format('word')} AS stem, min(word) AS node_id FROM tokens GROUP BY 1)"


def _stems(tokens):
    """Every token is a known stem; the first word of equals stands for it."""
    return tokens.groupBy(T.fold(F.col("word")).alias("stem")).agg(F.min("word").alias("node_id"))


@query(f"""WITH {_TOKENS}, {_SPLITS}, {_KNOWN}, best AS (SELECT word, prefix, stem, kind, node_id FROM splits LEFT JOIN known USING (stem) QUALIFY row_number() OVER (PARTITION BY word ORDER BY node_id IS NULL, length(prefix) DESC) = 1)
SELECT word, CASE WHEN prefix IS NULL THEN 'no-prefix' WHEN node_id IS NULL THEN 'no-corpus-evidence' WHEN kind = 'variable' THEN 'variable-stress' ELSE 'segmented' END AS status, coalesce(prefix, '') AS prefix, coalesce(stem, '') AS stem,
  CASE WHEN node_id IS NOT NULL AND kind <> 'variable' THEN kind ELSE '' END AS separability, CASE WHEN kind <> 'variable' THEN coalesce(node_id, '') ELSE '' END AS stem_node_id FROM tokens LEFT JOIN best USING (word)""")
def segmentation(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    out = morph.segment(tokens, _stems(tokens))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("word", "status", *map(empty, ("prefix", "stem", "separability", "stem_node_id")))


@query(f"""WITH {_TOKENS}, {_SPLITS}, {_KNOWN}, best AS (SELECT word, prefix, kind, node_id FROM splits LEFT JOIN known USING (stem) QUALIFY row_number() OVER (PARTITION BY word ORDER BY node_id IS NULL, length(prefix) DESC) = 1)
SELECT word, kind = 'variable' AND node_id IS NOT NULL AS human FROM best WHERE node_id IS NULL OR kind = 'variable'""")
def withheld_for_people(spark, sf_dir):
    """Words that stay whole, and which of them a person could settle."""
    tokens = _tokens(spark, sf_dir)
    out = morph.segment(tokens, _stems(tokens)).where("status not in ('segmented', 'no-prefix')")
    return out.select("word", needs_human(F.col("status")).alias("human"))


_GRID = f"""{_TOKENS}, {_KNOWN}, pre AS (SELECT * FROM (VALUES ('ab', 'separable'), ('an', 'separable'), ('auf', 'separable'), ('be', 'inseparable'), ('um', 'variable'), ('ver', 'inseparable')) v(prefix, kind)),
roots AS (SELECT stem AS root, CASE WHEN length(stem) % 3 = 0 THEN 'drifted' END AS transparency FROM known),
aims AS (SELECT DISTINCT word FROM tokens WHERE length(word) = 9 UNION SELECT 'um' || root FROM roots WHERE root < 'e'),
attested AS (SELECT {FOLD.format('word')} AS word, min(word) AS node_id FROM tokens GROUP BY 1),
cells AS (SELECT prefix, root, prefix || root AS word, kind, transparency FROM pre CROSS JOIN roots),
grid AS (SELECT c.prefix, c.root, c.word, CASE WHEN a.node_id IS NOT NULL THEN 'learned' WHEN c.word IN (SELECT word FROM aims) THEN 'identified' WHEN kind = 'variable' THEN 'withheld' WHEN transparency IS NOT NULL THEN 'irregular' ELSE 'gap' END AS state, coalesce(a.node_id, '') AS node_id FROM cells c LEFT JOIN attested a ON a.word = c.word)"""


def _grid(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    axis = spark.createDataFrame([("ab", "separable"), ("an", "separable"), ("auf", "separable"), ("be", "inseparable"), ("um", "variable"), ("ver", "inseparable")], "prefix string, kind string")
    roots = _stems(tokens).select(F.col("stem").alias("root"), F.when(F.length("stem") % 3 == 0, "drifted").alias("transparency"))
    aims = tokens.where("length(word) = 9").select("word").unionByName(roots.where("root < 'e'").select(F.concat(F.lit("um"), "root").alias("word")))
    known = tokens.groupBy(T.fold(F.col("word")).alias("word_")).agg(F.min("word").alias("node_id")).withColumnRenamed("word_", "word")
    cells = morph.grid_cells(axis, roots, known, aims, spark.createDataFrame([], "word string"))
    return cells.withColumn("node_id", F.coalesce("node_id", F.lit("")))


@query(f"WITH {_GRID} SELECT * FROM grid")
def prefix_root_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"WITH {_GRID} SELECT state, count(*) AS cells FROM grid GROUP BY state")
def grid_state_counts(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("state").agg(F.count("*").alias("cells"))


@query("SELECT doc_id AS id, relation, target FROM (SELECT doc_id, unnest(['governs', 'same_family']) AS relation, unnest([doc_id * 2, doc_id + 7]) AS target FROM documents) WHERE target NOT IN (SELECT doc_id FROM documents)")
def dangling_targets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    links = d.select(F.col("doc_id").alias("id"), F.explode(F.array(F.struct(F.lit("governs").alias("relation"), (F.col("doc_id") * 2).alias("target")), F.struct(F.lit("same_family").alias("relation"), (F.col("doc_id") + 7).alias("target")))).alias("l"))
    return morph.dangling_targets(links.select("id", "l.relation", "l.target"), d.select(F.col("doc_id").alias("id")))


_FAMILIES = f"""{_TOKENS}, {_SPLITS}, {_KNOWN}, best AS (SELECT word, prefix, stem, kind, node_id FROM splits LEFT JOIN known USING (stem) QUALIFY row_number() OVER (PARTITION BY word ORDER BY node_id IS NULL, length(prefix) DESC) = 1),
good AS (SELECT * FROM best WHERE node_id IS NOT NULL AND kind <> 'variable')"""


def _families(spark, sf_dir):
    """Each known stem is a family node whose lemmas are itself and the words that it carries."""
    tokens = _tokens(spark, sf_dir)
    roots = written(_stems(tokens), "stems")
    carried = morph.segment(tokens, roots).where("status = 'segmented'").select(F.col("stem_node_id").alias("id"), "word")
    lemmas = carried.groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("lemmas"))
    nodes = roots.select(F.col("node_id").alias("id"), F.col("node_id").alias("root")).join(lemmas, "id", "left")
    no_links = F.array().cast("array<struct<target:string,relation:string,confidence:double>>")
    nodes = nodes.select(
        "id", F.lit("vocab").alias("type"), F.get(F.array(F.lit("B1"), F.lit("A2"), F.lit("C1")), F.length("id") % 3).alias("cefr"), "root", F.coalesce("lemmas", F.array().cast("array<string>")).alias("lemmas"),
        F.lit(None).cast("boolean").alias("separable"), F.col("id").alias("title_de"), F.lit(None).cast("string").alias("family_transparency"), F.xxhash64("id").alias("seq"), no_links.alias("links"),
    )
    return written(nodes, "family_nodes")


@query(f"WITH {_FAMILIES} SELECT DISTINCT node_id AS candidate, 'prefix-' || prefix AS counterpart FROM good")
def family_links(spark, sf_dir):
    return morph.families(_families(spark, sf_dir))[0].select("candidate", "counterpart")


@query(f"WITH {_FAMILIES} SELECT prefix, 'prefix-' || prefix AS id, ['A2','B1','C1'][1 + min(CASE length(node_id) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END)::INT] AS cefr, count(DISTINCT node_id) AS families, count(DISTINCT word) AS members FROM good GROUP BY prefix")
def prefix_nodes_to_create(spark, sf_dir):
    out = morph.families(_families(spark, sf_dir))[1]
    return out.select("prefix", "id", "cefr", F.size("families").cast("long").alias("families"), F.size("members").cast("long").alias("members"))


_HEADS = ("ab", "an", "auf", "be", "um", "ver")
_MATRIX = f"""{_FAMILIES}, rsplits AS (SELECT k.stem AS root, prefix, substr(k.stem, length(prefix) + 1) AS stem, kind FROM known k JOIN inv ON starts_with(k.stem, prefix) AND length(k.stem) - length(prefix) >= 3),
rbest AS (SELECT root, kind, known.stem IS NOT NULL AS there FROM rsplits LEFT JOIN known USING (stem) QUALIFY row_number() OVER (PARTITION BY root ORDER BY known.stem IS NULL, length(prefix) DESC) = 1),
axis AS (SELECT stem AS root FROM known WHERE stem NOT IN (SELECT root FROM rbest WHERE there AND kind <> 'variable')),
attested AS (SELECT {FOLD.format('word')} AS w FROM good UNION SELECT {FOLD.format('node_id')} FROM known)"""
_KINDS = {**{p: "separable" for p in morph.SEPARABLE}, **{p: "inseparable" for p in morph.INSEPARABLE}, **{p: "variable" for p in morph.VARIABLE}}
_CELLS = ", ".join(f"CASE WHEN '{p}' || root IN (SELECT w FROM attested) THEN 'learned' ELSE '{'withheld' if _KINDS[p] == 'variable' else 'gap'}' END AS \"{p}\"" for p in _HEADS)


@query(f"WITH {_MATRIX} SELECT root, {_CELLS} FROM axis")
def grid_matrix(spark, sf_dir):
    """The grid of the corpus's own axes, prefixes as columns: six prefix nodes, and families of all words."""
    own = _families(spark, sf_dir)
    heads = spark.createDataFrame([(f"prefix-{p}", p) for p in _HEADS], "id string, root string")
    heads = heads.select("id", F.lit("pattern").alias("type"), F.lit("A1").alias("cefr"), "root", F.array().cast("array<string>").alias("lemmas"), F.lit(True).alias("separable"), F.col("id").alias("title_de"), F.lit(None).cast("string").alias("family_transparency"), F.lit(-1).cast("long").alias("seq"), F.array().cast(dict(own.dtypes)["links"]).alias("links"))
    nodes = own.unionByName(heads)
    return morph.grid_matrix(morph.grid(nodes), list(_HEADS))


@query(f"""WITH {_FAMILIES} SELECT DISTINCT 'dangling' AS kind, node_id AS at, '-' || node_id AS name FROM known
UNION ALL SELECT DISTINCT 'ambiguous', s.node_id, b.word FROM best b JOIN known s USING (stem) WHERE b.node_id IS NOT NULL AND b.kind = 'variable' AND b.word IS NOT NULL""")
def corpus_gaps(spark, sf_dir):
    """What a corpus lacks: links to nowhere, and words that it cannot take apart by itself."""
    tokens = _tokens(spark, sf_dir)
    roots = written(_stems(tokens), "stems")
    unsure = morph.segment(tokens, roots).where("status = 'variable-stress'").select("word", "stem").join(roots.withColumnRenamed("node_id", "id"), "stem").groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("lemmas"))
    link = F.struct(F.concat(F.lit("-"), "id").alias("target"), F.lit("governs").alias("relation"), F.lit(None).cast("double").alias("confidence"))
    nodes = roots.select(F.col("node_id").alias("id")).join(unsure, "id", "left").select(
        "id", F.lit("vocab").alias("type"), F.lit("B1").alias("cefr"), F.col("id").alias("root"), F.coalesce("lemmas", F.array().cast("array<string>")).alias("lemmas"), F.lit(None).cast("boolean").alias("separable"), F.col("id").alias("title_de"),
        F.lit(None).cast("string").alias("family_transparency"), F.xxhash64("id").alias("seq"), F.array(link).alias("links"),
    )
    return morph.gaps(written(nodes, "nodes"))
