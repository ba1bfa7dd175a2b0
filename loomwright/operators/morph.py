"""Verb morphology: prefix candidates, segmentation by corpus evidence, the prefix-root grid, its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.level import level_name, level_order

# The prefix inventories in their published order; VARIABLE ones carry both stresses and win over the others.
SEPARABLE = (
    "auseinander", "gegenüber", "entgegen", "herunter", "herüber", "hinunter", "hinüber", "zusammen", "zurecht", "zurück", "vorbei", "voraus", "vorher", "herein", "heraus",
    "herauf", "herab", "hinein", "hinaus", "hinauf", "davon", "dazu", "empor", "fest", "statt", "teil", "weiter", "wieder", "nach", "über", "unter", "durch", "hinter",
    "voll", "wider", "auf", "aus", "bei", "ein", "fort", "her", "hin", "los", "mit", "vor", "weg", "zu", "ab", "an", "um",
)
INSEPARABLE = (
    "miss", "emp", "ent", "ver", "zer", "be", "ge", "er",
)
VARIABLE = (
    "um", "durch", "über", "unter", "wider", "wieder", "hinter", "voll",
)
SHORTEST_STEM = 3
UNTRUSTED = ("drifted", "opaque")
FAMILY = "same_family"
#: Rows of a prefix axis that may be broadcast.
MOST_PREFIXES = 1000


def prefixes(spark) -> DataFrame:
    """``prefix, kind, size``: a constant table of under 100 rows."""
    kind = {p: "separable" for p in SEPARABLE} | {p: "inseparable" for p in INSEPARABLE} | {p: "variable" for p in VARIABLE}
    return spark.createDataFrame([(p, k, len(p)) for p, k in sorted(kind.items())], "prefix string, kind string, size int")


def classify(prefix: Column) -> Column:
    p = T.casefold(prefix)
    return F.when(p.isin(list(VARIABLE)), "variable").when(p.isin(list(INSEPARABLE)), "inseparable").when(p.isin(list(SEPARABLE)), "separable")


def prefix_candidates(words: DataFrame, table: DataFrame | None = None, shortest: int = SHORTEST_STEM) -> DataFrame:
    """``word, prefix, stem, kind`` of every split that leaves a stem long enough.

    An equi-join: a word offers its own beginnings, as many as the longest prefix has letters.
    """
    # the own table is a constant of under 100 rows; of another one Spark checks the size
    table = table if table is not None else F.broadcast(prefixes(words.sparkSession))
    longest = max(map(len, [*SEPARABLE, *INSEPARABLE]))
    folded = words.select("word", T.fold(F.col("word")).alias("_w")).where(F.length("_w") > shortest)
    offers = folded.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_w") - shortest)))).withColumn("prefix", F.substring("_w", F.lit(1), F.col("size")))
    return offers.join(table.select("prefix", "kind"), "prefix").select("word", "prefix", F.expr("substring(_w, size + 1)").alias("stem"), "kind")


def stems(nodes: DataFrame) -> DataFrame:
    """``stem, node_id``: what the corpus vouches for. A root beats lemmas; the first lemma wins, the last root.

    Needs ``seq``, the nodes' order.
    """
    lemma = nodes.select("seq", "id", F.posexplode(F.coalesce("lemmas", F.array().cast("array<string>"))).alias("at", "lemma"))
    lemma = lemma.select(T.lemma_key(F.col("lemma")).alias("stem"), F.col("id").alias("node_id"), F.lit(1).alias("late"), F.col("seq").alias("o1"), F.col("at").alias("o2"))
    root = nodes.where("root <> ''").select(T.fold(F.col("root")).alias("stem"), F.col("id").alias("node_id"), F.lit(0).alias("late"), (-F.col("seq")).alias("o1"), F.lit(0).alias("o2"))
    both = lemma.unionByName(root).where("stem <> ''")
    return both.groupBy("stem").agg(F.min_by("node_id", F.struct("late", "o1", "o2")).alias("node_id"))


def segment(words: DataFrame, known: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``word, status, prefix, stem, separability, stem_node_id, resolved_by_node``.

    ``words`` has ``word`` and may have ``declared`` (a node's own ``separable``). The longest
    prefix whose stem the corpus vouches for decides; if that prefix is stress-dependent and
    nobody declared it, the word is withheld. ``status`` is ``segmented`` or the reason.
    """
    words = words if "declared" in words.columns else words.withColumn("declared", F.lit(None).cast("boolean"))
    words = words.distinct()
    split = prefix_candidates(words.select("word").distinct(), table).join(known.withColumnRenamed("node_id", "stem_node_id"), "stem", "left")
    best = split.groupBy("word").agg(F.min_by(F.struct("prefix", "stem", "kind", "stem_node_id"), F.struct(F.col("stem_node_id").isNull().alias("unknown"), (-F.length("prefix")).alias("size"))).alias("x"))
    out = words.join(best, "word", "left")
    variable, vouched = F.col("x.kind") == "variable", F.col("x.stem_node_id").isNotNull()
    status = F.when(F.col("x").isNull(), "no-prefix").when(~vouched, "no-corpus-evidence").when(variable & F.col("declared").isNull(), "variable-stress").otherwise("segmented")
    kind = F.when(variable, F.when(F.col("declared"), "separable").otherwise("inseparable")).otherwise(F.col("x.kind"))
    done = status == "segmented"
    return out.select("word", "declared", status.alias("status"), F.col("x.prefix").alias("prefix"), F.col("x.stem").alias("stem"), F.when(done, kind).alias("separability"), F.when(done, F.col("x.stem_node_id")).alias("stem_node_id"), F.when(done, variable).alias("resolved_by_node"))


def is_prefix_node(type_: Column, separable: Column) -> Column:
    return (type_ == "pattern") & separable.isNotNull()


def is_family_node(type_: Column, root: Column) -> Column:
    return (type_ == "vocab") & (F.coalesce(root, F.lit("")) != "")


def morpheme_of(root: Column, title: Column) -> Column:
    stated = F.regexp_replace(T.fold(root), "-+$", "")
    parsed = F.regexp_extract(title, r"(?U)^\s*([^\s(-]+)\s*-", 1)
    return F.when(F.coalesce(root, F.lit("")) != "", stated).when(parsed != "", T.fold(parsed))


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.explode("links").alias("l")).select("id", F.col("l.relation").alias("relation"), F.col("l.target").alias("target"))


def dangling_targets(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links to nodes that do not exist: ``id, relation, target``."""
    return links.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("id", "relation", "target")


def grid_cells(prefix_axis: DataFrame, root_axis: DataFrame, known: DataFrame, targets: DataFrame, ids: DataFrame) -> DataFrame:
    """Every prefix by every root with its state; the first reason that holds names it.

    ``prefix_axis(prefix, kind)`` has at most :data:`MOST_PREFIXES` rows (more are an error), so the product is linear in the roots.
    ``known(word, node_id)``, ``targets(word)``, ``ids(word)``: attested words, words that links
    aim at (as written), node ids (as written).
    """
    if prefix_axis.limit(MOST_PREFIXES + 1).count() > MOST_PREFIXES:
        raise ValueError(f"a prefix axis has at most {MOST_PREFIXES} rows")
    cells = root_axis.select("root", "transparency").crossJoin(F.broadcast(prefix_axis.select("prefix", "kind"))).withColumn("word", F.concat("prefix", "root"))
    aimed = targets.select("word").distinct().join(ids.select("word"), "word", "left_anti").withColumn("aimed", F.lit(True))
    cells = cells.join(known.select("word", "node_id"), "word", "left").join(aimed, "word", "left")
    trusted = ~F.coalesce(F.col("transparency").isin(list(UNTRUSTED)), F.lit(False))
    state = F.when(F.col("node_id").isNotNull(), "learned").when(F.col("aimed"), "identified").when(F.col("kind") == "variable", "withheld").when(~trusted, "irregular").otherwise("gap")
    return cells.select("prefix", "root", "word", state.alias("state"), "node_id")


def known_words(nodes: DataFrame) -> DataFrame:
    """``word, node_id``: lemmas (the first wins) and node ids (which win over lemmas). Needs ``seq``."""
    lemma = nodes.select("seq", "id", F.posexplode(F.coalesce("lemmas", F.array().cast("array<string>"))).alias("at", "lemma")).select(T.fold(F.col("lemma")).alias("word"), F.col("id").alias("node_id"), F.lit(1).alias("late"), "seq", "at")
    own = nodes.select(T.fold(F.col("id")).alias("word"), F.col("id").alias("node_id"), F.lit(0).alias("late"), (-F.col("seq")).alias("seq"), F.lit(0).alias("at"))
    return lemma.unionByName(own).groupBy("word").agg(F.min_by("node_id", F.struct("late", "seq", "at")).alias("node_id"))


def axes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix axis ``(prefix, kind, node_id)`` and root axis ``(root, node_id, transparency)`` of a corpus."""
    heads = nodes.where(is_prefix_node(F.col("type"), F.col("separable"))).withColumn("prefix", morpheme_of(F.col("root"), F.col("title_de"))).where("prefix <> ''")
    prefix_axis = heads.select("prefix", F.coalesce(classify(F.col("prefix")), F.lit("separable")).alias("kind"), F.col("id").alias("node_id"))
    family = nodes.where(is_family_node(F.col("type"), F.col("root"))).select("seq", "id", T.fold(F.col("root")).alias("root"), F.col("family_transparency").alias("transparency"))
    derived = segment(family.select(F.col("root").alias("word")), stems(nodes)).where("status = 'segmented'").select(F.col("word").alias("root"))
    base = family.join(derived, "root", "left_anti").groupBy("root").agg(F.max_by(F.struct("id", "transparency"), "seq").alias("x")).select("root", F.col("x.id").alias("node_id"), F.col("x.transparency").alias("transparency"))
    aims = heads.select("prefix", F.explode("links").alias("l")).where(F.col("l.relation") == FAMILY).select("prefix", T.fold(F.col("l.target")).alias("target"))
    implied = aims.where("startswith(target, prefix)").select(F.expr("substring(target, length(prefix) + 1)").alias("root")).where(F.length("root") >= SHORTEST_STEM).distinct().join(base.select("root"), "root", "left_anti")
    return prefix_axis, base.unionByName(implied.select("root", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("transparency")))


def grid(nodes: DataFrame) -> DataFrame:
    prefix_axis, root_axis = axes(nodes)
    ids = nodes.select(F.col("id").alias("word"))
    return grid_cells(prefix_axis, root_axis, known_words(nodes), edges(nodes).select(F.col("target").alias("word")), ids)


def grid_matrix(cells: DataFrame, prefixes: list[str]) -> DataFrame:
    """One row a root with a column for each prefix that holds the cell's state: a grid as people read it."""
    return cells.groupBy("root").pivot("prefix", prefixes).agg(F.first("state"))


def root_order(matrix: DataFrame, root_axis: DataFrame) -> DataFrame:
    """Roots that have a node before those that are only implied, each by name."""
    has = root_axis.select("root", F.col("node_id").isNotNull().alias("_written"))
    return matrix.join(has, "root", "left").orderBy(F.desc(F.coalesce("_written", F.lit(False))), "root").drop("_written")


def gaps(nodes: DataFrame) -> DataFrame:
    """``kind, at, name``: links whose target is no node (by target), and words whose prefix only a person can settle."""
    links = dangling_targets(edges(nodes), nodes).select(F.lit("dangling").alias("kind"), F.col("id").alias("at"), F.col("target").alias("name"))
    open_ = families(nodes)[2].where("status = 'variable-stress'").select(F.lit("ambiguous").alias("kind"), F.col("family").alias("at"), F.col("word").alias("name"))
    return links.unionByName(open_).distinct()


def families(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the corpus implies: ``(links, creates, withheld)``.

    ``links(candidate, counterpart, word, prefix, stem, stem_node_id)`` are family edges that
    are not declared, each once; ``creates(id, prefix, cefr, families, members)`` prefix nodes
    that are missing, at the lowest level among the families that use them; ``withheld`` the
    words that a person, or more study, must settle.
    """
    family = nodes.where(is_family_node(F.col("type"), F.col("root")))
    words = family.select("seq", F.col("id").alias("family"), "cefr", F.posexplode("lemmas").alias("at", "word"))
    done = segment(words.select("word"), stems(nodes)).drop("declared")
    found = words.join(done, "word")
    good = found.where("status = 'segmented'").withColumn("counterpart", F.concat(F.lit("prefix-"), F.col("prefix")))
    declared = edges(family).where(F.col("relation") == FAMILY).select(F.col("id").alias("family"), T.fold(F.col("target")).alias("counterpart")).distinct()
    fresh = good.join(declared, ["family", "counterpart"], "left_anti")
    first = Window.partitionBy("family", "counterpart").orderBy("at")
    links = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("family").alias("candidate"), "counterpart", "word", "prefix", "stem", "stem_node_id")
    prefix_axis, _ = axes(nodes)
    wanted = good.join(prefix_axis.select("prefix"), "prefix", "left_anti").join(nodes.select(F.col("id").alias("counterpart")), "counterpart", "left_anti")
    creates = wanted.groupBy("prefix").agg(F.first("counterpart").alias("id"), level_name(F.min(level_order(F.col("cefr")))).alias("cefr"), F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("word")).alias("members"))
    return links, creates, found.where("status in ('variable-stress', 'no-corpus-evidence')").select("family", "word", "status", "prefix", "stem")
