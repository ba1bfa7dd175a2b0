"""Personal data by weak supervision, in DataFrame expressions only.

Base finders (regular expressions with a check) always count. Beside them a wide pattern
proposes candidates, most of which are none: numbers in groups, long words and keys, disguised
addresses. Five labelers vote on each candidate (+1 personal, -1 not, 0 silent): strict shape,
randomness of the characters, trigger words before it, gazetteers of prefixes, countries and
domains, and contexts that speak against it. Expectation-maximisation over the vote patterns
(a table of bounded size: 3**5) estimates how reliable each labeler is; its posteriors are the
soft labels of the final span classifier, a naive Bayes model. The classifier does not see the
votes: it looks at the span's kind and shape, at the words before it (any words, also those
that no labeler knows) and the marks between. So what stands with spans that the labelers agree
on, on either side, decides about spans on which they are silent.
Candidates that it accepts are added; base finds stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import let
from loomwright.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "id", "account", "secret")
LABELERS = 5
THRESHOLD, ROUNDS = 0.9, 25
#: Votes that a labeler's first reliability counts as, and spans that a feature's first odds count as.
VOTES, SPANS = 20.0, 20.0
#: Words before a span that the classifier looks at, and what those outside of all lists are hashed into.
BEFORE, WORD_BUCKETS = 3, 1024

# A match starts where its first run of characters starts, or where the last match ended:
# starting later in the run can't match where that start doesn't. So scans stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WIDE = (
    r"(?<![A-Za-z0-9+@._-])(?:"
    # numbers in groups: identity numbers, phone numbers, but book numbers and dates too
    r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
    r"|[0-9]{1,5}(?:[.-][0-9]{1,7}){2,6}+(?![0-9])"
    r"|[A-Za-z0-9._-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++"
    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    # long words and keys of any length; what dots join to them is part of them (header.payload.signature)
    r"|(?:SG\.)?+[A-Za-z0-9_/+=-]{20,}+(?:\.[A-Za-z0-9_/+=-]++)*+)"
)

# Trigger words before a span by kind, words that speak against, and the gazetteers.
TRIGGERS = {
    "email": ("mail", "email", "contact", "write", "adresse", "correo"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "handy"),
    "id": ("ssn", "social", "security", "passport", "licence", "identity", "steuer"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("key", "apikey", "token", "secret", "password", "passwd", "pwd", "api", "auth", "bearer", "credential", "credentials"),
}
AGAINST = (
    "version", "isbn", "issn", "doi", "page", "pages", "commit", "revision", "rev", "build", "sha", "md5", "hash", "checksum", "digest", "file", "filename", "http", "https",
    "www", "url", "date", "order", "invoice", "chapter", "section", "release",
)
SECRET_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_", "pk_", "rk_", "xoxa", "xoxb", "xoxp", "eyJ", "key-", "SG.")
ACCOUNT_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK")
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "info")
# Chance of the votes -1, 0, +1 on true and on false spans, for each labeler (shape,
# randomness, trigger, gazetteer, against), from which estimation starts.
FIRST_YES = ((0.05, 0.25, 0.7), (0.1, 0.2, 0.7), (0.01, 0.39, 0.6), (0.05, 0.65, 0.3), (0.02, 0.97, 0.01))
FIRST_NO = ((0.6, 0.35, 0.05), (0.7, 0.2, 0.1), (0.01, 0.94, 0.05), (0.1, 0.89, 0.01), (0.3, 0.69, 0.01))
# Log odds that features of the classifier start with: words before a span, and shapes.
FIRST_ODDS = (
    {f"word:{k}:{w}": 3.5 for k, words in TRIGGERS.items() for w in words}
    | {f"word:{k}:{w}": -5.0 for k in KINDS for w in AGAINST}
    | {"shape:id:3-2-4": 1.5, "shape:phone:(3) 3-4": 3.0, "shape:email": 3.0, "shape:account:country": 3.0, "shape:secret:prefix": 6.0}
)


def prefix_sums(sizes: Column) -> Column:
    """Sum of what stands before each element; 256 elements at a time, so long arrays stay cheap."""
    def block(c: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), c * 256), F.lit(0), lambda acc, x: acc + x)
        start = F.struct(F.array().cast("array<int>").alias("seen"), before.alias("at"))
        part = F.slice(sizes, c * 256 + 1, F.lit(256))
        return F.aggregate(part, start, lambda acc, x: F.struct(F.concat(acc["seen"], F.array(acc["at"])).alias("seen"), (acc["at"] + x).alias("at")), lambda acc: acc["seen"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 256).cast("int"))
    return F.when(F.size(sizes) > 0, F.flatten(F.transform(blocks, block))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, begin: Column | None = None) -> Column:
    """All matches, leftmost and non-overlapping: ``array<struct<start, end, hit, left, right>>``.

    Offsets are code points. They follow from the lengths of the pieces between matches, which
    also give the 40 characters before and the one after each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if begin is not None:
        found = F.when(begin, found).otherwise(F.array().cast("array<string>"))

    def place(hits: Column) -> Column:
        def spans(gaps: Column) -> Column:
            sizes = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
            return let(
                prefix_sums(sizes),
                lambda starts: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(starts, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"),
                        h.alias("hit"),
                        F.right(F.get(gaps, i), F.lit(40)).alias("left"),
                        F.substring(F.get(gaps, i + 1), 1, 1).alias("right"),
                    ),
                ),
            )

        none = F.array().cast("array<struct<start:int,end:int,hit:string,left:string,right:string>>")
        return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), spans)).otherwise(none)

    return let(found, place)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.split(F.reverse(_digits(hit)), "")
    total = F.aggregate(
        F.transform(digits, lambda d, i: let(F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0),
        lambda acc, x: acc + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right")))


def base_spans(text: Column) -> Column:
    """The base finds by start, then kind: ``array<struct<start, kind, end, hit, left, right>>``."""
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP), lambda x: x["hit"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
    card = F.filter(matches(text, CARD), lambda x: F.length(_digits(x["hit"])).between(12, 19) & _luhn(x["hit"]))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["hit"])).between(9, 15))
    return F.array_sort(F.concat(_named("email", email), _named("ip", ip), _named("card", card), _named("phone", phone)))


def _wide_kind(hit: Column) -> Column:
    rules = [
        ("phone", r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
        ("id", r"^[0-9]{1,5}(?:[.-][0-9]{1,7}){2,6}$"),
        ("email", r"[\[(]at[\])]"),
        ("account", r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"),
    ]
    return reduce(lambda rest, rule: F.when(hit.rlike(rule[1]), F.lit(KINDS.index(rule[0]))).otherwise(rest), reversed(rules), F.lit(KINDS.index("secret")))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _words(names: tuple[str, ...], behind: str = r"\b[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+){0,2}$") -> str:
    """One of some words, whole, among the last three before a span."""
    return rf"\b(?:{'|'.join(names)}){behind}"


PREFIXED = f"^(?:{'|'.join(x.replace('.', '[.]') for x in SECRET_PREFIXES)})"


def votes(span: Column) -> Column:
    """The five labelers' votes on a span, ``array<int>`` of -1, 0 and 1."""
    kind, hit, left = span["kind"], span["hit"], F.lower(span["left"])
    is_ = {k: kind == i for i, k in enumerate(KINDS)}
    hexes = hit.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{38}|[0-9a-f]{40}|[0-9a-f]{64})$") & hit.rlike("[0-9]")
    number = hit.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    words = ~hit.rlike("[0-9]") | hit.rlike(r"^(?:[A-Za-z]+|[0-9]+|v[0-9]+)(?:[-_/.](?:[A-Za-z]+|[0-9]+|v[0-9]+))+$")
    shape = _vote((is_["secret"] & ~words & (hexes | hit.rlike(PREFIXED))) | (is_["id"] & number) | (is_["phone"] & hit.startswith("(")) | is_["email"], (is_["id"] & ~number) | (is_["secret"] & words))
    letters, digits = F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), F.length(_digits(hit))
    turns = F.size(F.regexp_extract_all(hit, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0)))
    kinds_of_chars = F.size(F.array_distinct(F.split(hit, "")))
    random = _vote(F.when(is_["secret"], (turns >= 4) & (digits >= 4) & (letters >= 4) & (kinds_of_chars >= 10)).when(is_["email"], letters >= 3).otherwise(kinds_of_chars >= 4), F.lit(True))
    trigger = reduce(lambda rest, k: F.when(is_[k], left.rlike(_words(TRIGGERS[k]))).otherwise(rest), KINDS, F.lit(False))
    context = _vote(trigger, F.lit(False))
    gazetteer = _vote(
        (is_["secret"] & hit.rlike(PREFIXED)) | (is_["account"] & F.substring(hit, 1, 2).isin(list(ACCOUNT_COUNTRIES))) | (is_["email"] & F.lower(hit).rlike(rf"(?:{'|'.join(DOMAIN_ENDS)})$")),
        is_["account"],
    )
    against = _vote(F.lit(False), left.rlike(_words(AGAINST)) | left.rlike(r"/$") | span["right"].rlike("[A-Za-z0-9_]"))
    return F.array(shape, random, context, gazetteer, against)


def _shape(span: Column) -> Column:
    """What a span looks like: groups of digits, or characters, length and how they mix."""
    kind, hit = span["kind"], span["hit"]
    is_ = {k: kind == i for i, k in enumerate(KINDS)}
    marks = F.concat(*(F.when(hit.rlike(p), F.lit(c)).otherwise(F.lit("-")) for p, c in (("[A-Z]", "U"), ("[a-z]", "l"), ("[0-9]", "d"), ("[^A-Za-z0-9]", "s"))))
    turns = F.size(F.regexp_extract_all(hit, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0)))
    mixed = F.least(F.floor(turns * 10 / F.length(hit)), F.lit(5)).cast("string")
    size = F.floor(F.log2(F.length(hit).cast("double")) * 2).cast("string")
    parts = F.split(hit, "[.-]")
    groups = F.when(F.size(parts) > 4, F.size(parts).cast("string")).otherwise(F.array_join(F.transform(parts, lambda g: F.length(g).cast("string")), "-"))
    phone = F.when(hit.startswith("("), F.lit("(3) 3-4")).otherwise(F.lit("3-3-4"))
    account = F.when(F.substring(hit, 1, 2).isin(list(ACCOUNT_COUNTRIES)), F.lit("country")).otherwise(F.lit("other"))
    secret = F.when(hit.rlike(PREFIXED), F.lit("prefix")).otherwise(F.concat_ws(":", marks, size, mixed))
    return F.when(is_["id"], F.concat(F.lit("shape:id:"), groups)).when(is_["phone"], F.concat(F.lit("shape:phone:"), phone)).when(is_["account"], F.concat(F.lit("shape:account:"), account)).when(is_["email"], F.lit("shape:email")).otherwise(F.concat(F.lit("shape:secret:"), secret))


def features(span: Column) -> Column:
    """Features of a span for the classifier, as names: kind, shape, marks around it, the words before it.

    None of them is a vote. Each has a bounded number of values, so the model is of bounded size.
    """
    kind = F.get(F.array(*map(F.lit, KINDS)), span["kind"])
    known = F.array(*map(F.lit, sorted({*AGAINST, *(w for words in TRIGGERS.values() for w in words)})))
    # a cut word at the window's start is no word
    words = F.regexp_extract_all(F.lower(span["left"]), F.lit(r"(?<![\p{L}\p{N}])\p{L}+(?!\p{L})"), F.lit(0))
    last = F.slice(F.reverse(words), 1, BEFORE)
    before, others = F.array_intersect(last, known), F.array_except(last, known)
    gap = F.regexp_replace(F.regexp_replace(F.regexp_extract(span["left"], r"[^\p{L}\p{N}]*$", 0), r"\s+", " "), r"[^ -~]", "x")
    behind = F.when(span["right"] == "", "end").when(span["right"].rlike(r"[\p{L}\p{N}]"), "word").when(span["right"].rlike(r"\s"), "space").when(span["right"].rlike("[!-~]"), span["right"]).otherwise("other")
    return F.concat(
        F.array(F.concat(F.lit("kind:"), kind), _shape(span), F.concat_ws(":", F.lit("gap"), kind, F.right(gap, F.lit(2))), F.concat_ws(":", F.lit("behind"), kind, behind)),
        F.transform(before, lambda w: F.concat_ws(":", F.lit("word"), kind, w)),
        # words outside of all lists, by hash: what they tell is learned
        F.array_distinct(F.transform(others, lambda w: F.concat(F.lit("word:"), kind, F.lit(":#"), F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("string")))),
    )


def candidates(text: Column, base: Column) -> Column:
    """Spans of the wide pattern that touch no base find, with their kinds."""
    wide = F.transform(matches(text, WIDE), lambda x: F.struct(x["start"].alias("start"), _wide_kind(x["hit"]).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right")))
    return F.filter(wide, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def _table(rows: tuple[tuple[float, ...], ...]) -> str:
    return f"array({', '.join('array(' + ', '.join(f'{x}D' for x in r) + ')' for r in rows)})"


_EM = f"""
aggregate(
  sequence(1, {{rounds}}),
  named_struct('prior', 0.5D, 'yes', {_table(FIRST_YES)}, 'no', {_table(FIRST_NO)}),
  (model, round) -> transform(array(transform(seen, p -> named_struct('n', p.n, 'votes', p.votes,
      'r', 1D / (1D + exp(
        aggregate(sequence(0, {LABELERS - 1}), ln((1D - model.prior) / model.prior),
          (acc, j) -> acc + ln(model.no[j][p.votes[j] + 1] / model.yes[j][p.votes[j] + 1]))))))),
    soft -> transform(array(named_struct(
        'all', aggregate(soft, 0D, (acc, p) -> acc + p.n),
        'yes', aggregate(soft, 0D, (acc, p) -> acc + p.n * p.r))),
      total -> named_struct(
        'prior', (total.yes + 1D) / (total.all + 2D),
        'yes', transform(sequence(0, {LABELERS - 1}), j -> transform(sequence(-1, 1), v ->
          (aggregate(soft, 0D, (acc, p) -> acc + if(p.votes[j] = v, p.n * p.r, 0D)) + {VOTES}D * {_table(FIRST_YES)}[j][v + 1]) / (total.yes + {VOTES}D))),
        'no', transform(sequence(0, {LABELERS - 1}), j -> transform(sequence(-1, 1), v ->
          (aggregate(soft, 0D, (acc, p) -> acc + if(p.votes[j] = v, p.n * (1D - p.r), 0D)) + {VOTES}D * {_table(FIRST_NO)}[j][v + 1]) / (total.all - total.yes + {VOTES}D)))))[0])[0])
"""


def reliabilities(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: prior and, for each labeler, the chance of each vote on true and false spans.

    ``spans`` has ``votes`` and may have ``n``, how often. Only the counts of the vote patterns
    come together, 243 at most. A labeler that never spoke keeps its first reliability.
    """
    seen = spans.groupBy("votes").agg(F.sum(F.col("n") if "n" in spans.columns else F.lit(1)).cast("double").alias("n"))
    return seen.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("seen")).select(F.expr(_EM.format(rounds=rounds)).alias("model"))


def scan(docs: DataFrame, text_col: str = "text", base_out: str = "pii_base", wide_out: str = "pii_wide") -> DataFrame:
    """``docs`` with the base finds and the candidates of each whole text; a null text counts as empty."""
    clash = {base_out, wide_out, "__text"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn(base_out, base_spans(F.col("__text")))
    return rows.withColumn(wide_out, candidates(F.col("__text"), F.col(base_out))).drop("__text")


def train(scanned: DataFrame, rounds: int = ROUNDS, wide_col: str = "pii_wide") -> DataFrame:
    """One row ``(odds map<string, double>)``: the span classifier, from the candidates of :func:`scan`.

    All candidates are counted. The odds of a feature are the log ratio of its shares among
    true and false spans, drawn towards its first odds (0 for most) as if these came from 20
    spans; those of a kind are its log odds as such. Features have a bounded number of values,
    which bounds the map.
    """
    spans = scanned.select(F.explode(wide_col).alias("x")).select(votes(F.col("x")).alias("votes"), features(F.col("x")).alias("features"))
    # counted by pattern before anything is joined, so a hot kind of span is summed where it is read
    counted = written(spans.groupBy("votes", "features").agg(F.count("*").alias("n")), "patterns")
    model = written(reliabilities(counted, rounds), "reliabilities")
    odds = reduce(
        lambda acc, j: acc + F.ln(F.expr(f"model.yes[{j}][votes[{j}] + 1] / model.no[{j}][votes[{j}] + 1]")),
        range(LABELERS),
        F.ln(F.expr("model.prior / (1D - model.prior)")),
    )
    # one row of model: the join is a projection
    soft = counted.crossJoin(F.broadcast(model)).select("features", "n", (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("r"))
    sums = soft.agg(F.coalesce(F.sum(F.col("n") * F.col("r")), F.lit(0.0)).alias("yes"), F.coalesce(F.sum(F.col("n") * (1 - F.col("r"))), F.lit(0.0)).alias("no"))
    by = soft.select(F.explode("features").alias("feature"), "n", "r").groupBy("feature").agg(F.sum(F.col("n") * F.col("r")).alias("fy"), F.sum(F.col("n") * (1 - F.col("r"))).alias("fn"))
    spark = scanned.sparkSession
    first = spark.createDataFrame([(f, float(x)) for f, x in FIRST_ODDS.items()], "feature string, first double")
    by = by.join(F.broadcast(first), "feature", "full").select("feature", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fy", "fn", "first")))
    ratio = F.ln((F.col("fy") + 0.5) / (F.col("yes") + 1) * (F.col("no") + 1) / (F.col("fn") + 0.5))
    plain = F.ln((F.col("fy") + 0.5) / (F.col("fn") + 0.5))
    many = F.col("fy") + F.col("fn")
    drawn = (many * F.when(F.col("feature").startswith("kind:"), plain).otherwise(ratio) + SPANS * F.col("first")) / (many + SPANS)
    scored = by.crossJoin(F.broadcast(sums)).select("feature", drawn.alias("odds"))
    return written(scored.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "odds")))).alias("odds")), "classifier")


def decide(scanned: DataFrame, classifier: DataFrame, threshold: float = THRESHOLD, spans_out: str = "pii_spans", base_col: str = "pii_base", wide_col: str = "pii_wide") -> DataFrame:
    """``scanned`` with all spans, and the base ones, as ``array<struct<start: int, kind: int, end: int>>``, without the candidates."""
    if spans_out in scanned.columns:
        raise ValueError(f"columns are named like results: {[spans_out]}")
    # one row: the join is a projection
    rows = scanned.crossJoin(F.broadcast(classifier.select(F.col("odds").alias("__odds"))))
    odds = F.col("__odds")

    def accepted(x: Column) -> Column:
        score = F.aggregate(features(x), F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(odds, f), F.lit(0.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) >= threshold

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    more = F.filter(F.col(wide_col), accepted)
    rows = rows.withColumn(spans_out, F.array_sort(F.concat(bare(F.col(base_col)), bare(more)))).withColumn(base_col, bare(F.col(base_col)))
    return rows.drop(wide_col, "__odds")


def find(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, classifier: DataFrame | None = None, spans_out: str = "pii_spans", base_out: str = "pii_base") -> DataFrame:
    """``docs`` with all spans and the base ones: ``array<struct<start: int, kind: int, end: int>>``.

    Texts are scanned once; without a ``classifier`` one is trained on all of them. Spans are
    by start, then kind (a place in ``KINDS``), in code points, end exclusive. A null text
    counts as empty and has no spans; other columns pass through; repeated rows and ids do not
    matter; columns of ``docs`` named like results are an error; no rows give no rows.
    """
    clash = {spans_out, "__odds", "__wide"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    scanned = written(scan(docs, text_col, base_out, "__wide"), "scanned")
    if classifier is None:
        classifier = train(scanned, wide_col="__wide")
    return decide(scanned, classifier, threshold, spans_out, base_out, "__wide")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets.

    Where spans overlap, the first one's mark stands for its whole span and the next one's for
    what it holds beyond that, so nothing of any span stays; a span within another leaves no
    mark. A null text stays null; a text without spans stays as it is.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        put = F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.get(names, x["kind"]))).alias("parts"))
        return F.when(x["end"] > acc["at"], put).otherwise(acc)

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
