"""Text normalisations and scalar text functions, as Column expressions.

Unicode normal forms are not built into Spark: :func:`nfc` and :func:`nfkc` are Arrow UDFs.
Functions that need one take ``form``, a function on columns, with no normal form as the
default: that keeps plain text inside generated code.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Form = Callable[[Column], Column]
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"
SHINGLE = 5
E5_PREFIX = "query: "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def plain(x: Column) -> Column:
    return x


def _normal_form(name: str) -> Form:
    @F.pandas_udf("string")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize(name, s))

    return apply


def nfc(x: Column) -> Column:
    return _normal_form("NFC")(x)


def nfkc(x: Column) -> Column:
    return _normal_form("NFKC")(x)


def nfkd_bare(x: Column) -> Column:
    """Decomposed, without combining marks."""
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return apply(x)


def squeeze(x: Column) -> Column:
    """White space (of Unicode) as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def casefold(x: Column) -> Column:
    """Lower case with sharp s as ss: what case folding does to German text."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalize_for_hash(x: Column, form: Form = plain) -> Column:
    return squeeze(F.lower(form(x)))


def fold(x: Column, form: Form = plain) -> Column:
    """Folding of lemmas, stems and ids."""
    return casefold(strip(form(x)))


def fold_open(x: Column, form: Form = plain) -> Column:
    """Folding of a text that grammar rules search: outer space stays."""
    return casefold(form(x))


def fold_words(x: Column, form: Form = plain) -> Column:
    """Letters and digits only, lower-cased, single spaces."""
    return F.trim(F.regexp_replace(F.lower(form(x)), r"[^\p{L}\p{N}]+", " "))


def norm_tag(x: Column) -> Column:
    return F.lower(squeeze(x))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def lines(x: Column) -> Column:
    return F.split(x, LINE_BREAK)


def strip_markdown(x: Column) -> Column:
    """Prose of a Markdown text: headings, tables, rules, bullets, emphasis and tags go."""
    kept = F.filter(F.transform(lines(x), strip), lambda s: (s != "") & ~s.rlike(r"^[#|]") & ~s.rlike(r"^[-|: ]*$"))

    def clean(s: Column) -> Column:
        for pattern, put in ((r"(?U)^[-*+]\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`(.+?)`", "$1"), (r"\[(.+?)\]", "")):
            s = F.regexp_replace(s, pattern, put)
        return strip(s)

    return F.array_join(F.filter(F.transform(kept, clean), lambda s: s != ""), " ")


def embed_text(title: Column, body: Column) -> Column:
    prose, name = strip_markdown(body), strip(title)
    return F.when(prose == "", F.concat(F.lit(E5_PREFIX), name)).otherwise(strip(F.concat(F.lit(E5_PREFIX), name, F.lit(". "), prose)))


def shingles(x: Column, size: int = SHINGLE, form: Form = plain) -> Column:
    """Distinct character n-grams of the normalised text; a text no longer than one is its own.

    One regular expression reads them in a single pass: taking substrings by number would walk
    the text again for each.
    """
    text = normalize_for_hash(x, form)
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}})).")))
    return F.when(F.length(text) > size, grams).when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def could_reach(size_a: Column, size_b: Column, threshold: float) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return (size_a > 0) & (size_b > 0) & (F.least(size_a, size_b) / F.greatest(size_a, size_b) >= threshold)


def _slug_head(x: Column, longest: int) -> Column:
    """As much of a text as its slug can need: so many runs of letters and digits have at least as many characters."""
    return F.regexp_extract(x, rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{0,{longest}}}+\p{{M}}*+", 0)


def _slug(x: Column, longest: int, fallback: str) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    short = F.regexp_replace(F.substring(dashed, 1, longest), r"^-+|-+$", "")
    return F.when(short == "", F.lit(fallback)).otherwise(short)


# How German letters are written in ASCII, and letters with marks without them.
GERMAN_ASCII = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))
MARKED = "áàâãåéèêëíìîïóòôõúùûýÿñçÁÀÂÃÅÉÈÊËÍÌÎÏÓÒÔÕÚÙÛÝÑÇ"
BARE = "aaaaaeeeeiiiioooouuuyyncAAAAAEEEEIIIIOOOOUUUYNC"


def slugify(x: Column, longest: int = 40, fallback: str = "quelle", form: Form | None = None) -> Column:
    """ASCII slug of a source. ``form`` takes marks off; by default those of Western letters."""
    x = _slug_head(x, longest)
    for letter, put in GERMAN_ASCII:
        x = F.replace(x, F.lit(letter), F.lit(put))
    return _slug(form(x) if form else F.translate(x, MARKED, BARE), longest, fallback)


def node_slug(x: Column, longest: int = 60, fallback: str = "konzept", form: Form = plain) -> Column:
    """Slug of a node: German letters stay."""
    return _slug(form(_slug_head(x, longest)), longest, fallback)


def lemma_key(x: Column, form: Form = plain) -> Column:
    """Folded lemma without article or reflexive pronoun, each taken off once, in this order."""
    key = fold(x, form)
    for noise in ("der ", "die ", "das ", "sich "):
        key = F.regexp_replace(key, f"^{noise}", "")
    return strip(key)


def example_lines(body: Column) -> Column:
    """Example sentences: bullets under an examples heading, without trailing tags and gloss."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        opens = bare.rlike(r"(?iU)^#{1,6}\s*(examples|beispiele)\b")
        closes = bare.rlike(r"(?U)^#{1,6}\s")
        text = strip(F.regexp_replace(line, r"(?U)^\s*[-*+]\s+", ""))
        for tail in (r"(?U)\s*\[[^\[\]]*\]\s*$", r"(?U)\s*\([^()]*\)\s*$"):
            text = F.regexp_replace(text, tail, "")
        text = strip(text)
        takes = acc["inside"] & ~closes & line.rlike(r"(?U)^\s*[-*+]\s+") & (text != "")
        inside = F.when(opens, True).when(closes, False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.when(takes & ~opens, F.concat(acc["found"], F.array(text))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(lines(body), start, step, lambda acc: acc["found"])


def strip_fences(x: Column) -> Column:
    """Text without a wrapping code fence; an unfenced one is only stripped."""
    bare = strip(x)
    rest = F.slice(lines(bare), 2, F.greatest(F.size(lines(bare)) - 1, F.lit(1)))
    inner = F.when((F.size(rest) > 0) & strip(F.element_at(rest, -1)).startswith("```"), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    return F.when(bare.startswith("```"), F.when(F.size(lines(bare)) < 2, F.lit("")).otherwise(strip(F.array_join(inner, "\n")))).otherwise(bare)


def proposal_id(kind: Column, candidate: Column, counterpart: Column | None = None, relation: Column | None = None) -> Column:
    """Stable id of what is proposed: kind, shortened candidate, hash of all four parts."""
    parts = [F.coalesce(p, F.lit("")) if p is not None else F.lit("") for p in (counterpart, relation)]
    digest = F.substring(F.sha2(F.concat_ws("|", kind, candidate, *parts), 256), 1, 8)
    return F.concat_ws("-", kind, F.regexp_replace(F.substring(candidate, 1, 40), "^-+|-+$", ""), digest)


def data_uri(media_type: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def redact_data_uri(x: Column) -> Column:
    """A data URI as the hash of its bytes; other texts as they are."""
    return F.when(x.rlike(r"^data:[^;,]*;base64,"), F.concat(F.lit("sha256:"), F.sha2(F.unbase64(F.substring_index(x, ",", -1)), 256))).otherwise(x)
