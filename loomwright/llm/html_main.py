"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, and elements that
training found outside of articles weigh on what they hold; the run of tokens with the
greatest sum, found in one linear scan, is the content region. The weights come from labelled
pages, those whose markup says where their article is. The label itself (``<article>``,
``<main>`` and the like) is no token and is not looked at when a page is read. An element
whose words weigh negative, as an advert between two paragraphs, is one negative token with
all it holds, and its words are left out of the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.shared import slices, small_batches

#: Labelled pages at most from which weights are learned; they bound the features.
TRAIN_PAGES = 2_000
#: Words that a prior weighs as much as, and the share within articles that it gives to elements of known names.
PRIOR_WORDS, PRIOR_SHARE = 50, 0.02
#: Scores are cut here; a word in an element within a line stays above 0.
LOWEST, LOWEST_INLINE = -8.0, -0.8
#: Part of its score that an element of negative words weighs as one token.
UNIT = 0.25
#: A block is one of links if they hold this share of its words.
LINKS = 0.8

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'=<>`]+))?")
_IN_TAG = re.compile(r"[^\"'>]*")
_RAW_END = {n: re.compile(rf"</{n}\b[^>]*>", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}

# Elements without content, elements within a line, elements that hold no text to
# read, and names of elements that seldom hold main text, from which learning starts.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
NOT_TEXT = frozenset((
    "audio", "canvas", "datalist", "frame", "head", "iframe", "noembed", "noframes", "noscript", "object", "option", "script", "select", "style", "svg", "template",
    "textarea", "title", "video",
))
SELDOM_TAGS = ("aside", "button", "dialog", "fieldset", "footer", "form", "header", "input", "legend", "menu", "nav")
SELDOM_NAMES = (
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist",
    "comments", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommendations", "recommended", "related", "replies",
    "reply", "respond", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "toolbar",
    "topbar", "widget", "widgets",
)
SELDOM_ROLES = ("alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search")
ARTICLE_NAMES = frozenset(("article", "entry", "post", "story"))
TITLE_NAMES = ARTICLE_NAMES | {"content", "page", "title"}
NOT_ITSELF = frozenset(("closed", "has", "no", "not", "open", "with", "without"))
PROSE = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p"))
ONE_COMMENT = frozenset(("comment", "reply"))
PRIOR = {f"<{n}>": PRIOR_SHARE for n in SELDOM_TAGS} | {f".{n}": PRIOR_SHARE for n in SELDOM_NAMES} | {f"@{n}": PRIOR_SHARE for n in SELDOM_ROLES}


@dataclass
class Element:
    """An element of a page: its place in the tree, its features, its label, and the words it holds.

    Features are the tag, then what class, id and role say. The tag of an element that holds
    paragraphs or headings is told from one of the same name that does not.
    """

    parent: int
    name: str
    features: tuple[str, ...] = ()
    mark: int = 0
    within: bool = False
    gone: bool = False
    prose: bool = False
    words: int = 0
    links: int = 0
    labelled: int = 0


@dataclass
class Weights:
    """Score of a word, of an unknown tag, of each tag, and what elements of a feature add to their words."""

    word: float = 1.0
    other: float = -0.2
    tags: dict[str, float] = field(default_factory=dict)
    elements: dict[str, float] = field(default_factory=lambda: {f: _weight(0, 0, p) for f, p in PRIOR.items()})

    def tag(self, name: str, linked: bool) -> float:
        """What a tag costs where it stands; in a block of links an unknown one costs what it does anywhere."""
        if (known := self.tags.get(placed(name, linked))) is not None:
            return known
        return self.tags.get(name, self.other) if linked else self.other

    def of(self, e: Element, linked: bool) -> float:
        """What an element adds: by its classes, ids and roles where training knows one, else by its tag; a link among sentences adds nothing by that."""
        tag, *named = e.features or ("",)
        known = [self.elements[f] for f in named if f in self.elements]
        low = min(known) if known else self.elements.get(tag, 0.0) if linked or e.name not in INLINE else 0.0
        return max(low, LOWEST_INLINE) if e.name in INLINE else low


def placed(name: str, linked: bool) -> str:
    """A tag together with where it stands: a list of links is not a list of sentences."""
    return name + ("~links" if linked else "~text")


def _weight(inside: float, outside: float, share: float) -> float:
    p = (inside + PRIOR_WORDS * share) / (inside + outside + PRIOR_WORDS)
    return max(LOWEST, min(0.0, math.log(p / (1 - p)))) if p < 1 else 0.0


def _hints(tag: str) -> tuple[set[str], set[str], bool]:
    """Names in class and id, names in role and itemprop, and whether the element is hidden."""
    names: set[str] = set()
    roles: set[str] = set()
    hidden = False
    for m in _ATTR.finditer(tag):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id"):
            names.update(x for x in re.split(r"[^a-z0-9]+", value) if x)
        elif key in ("role", "itemprop"):
            roles.add(value)
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none", value))
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
    return names, roles, hidden


def _tag_end(page: str, at: int, none_after: dict[str, int]) -> int:
    """Where the tag that starts at ``at`` ends: behind the first ``>`` outside quotes, whatever stands within them.

    A quote that is never closed does not count; nor do quotes if no ``>`` follows outside of them.
    """
    x = at
    while True:
        x = _IN_TAG.match(page, x).end()
        if x >= len(page):
            break
        if page[x] == ">":
            return x + 1
        quote = page[x]
        close = -1 if x >= none_after.get(quote, len(page)) else page.find(quote, x + 1)
        if close < 0:
            none_after[quote] = min(none_after.get(quote, len(page)), x)
        x = max(x, close) + 1
    close = page.find(">", at)
    return close + 1 if close >= 0 else len(page)


def parse(page: str) -> tuple[list[tuple[str, str, int]], list[Element]]:
    """``(items, elements)``: items are ``(kind, value, element)``, kind "text" (not decoded), "tag" or "block".

    "block" stands for a border between blocks. Elements that hold no text to read, or are
    hidden, are skipped with all they hold. Markup that isn't closed or nested well is read
    leniently: an end tag closes what was opened since its start tag, one without a start tag
    closes nothing, and the start of an article ends elements left open that seldom hold one.
    """
    items: list[tuple[str, str, int]] = []
    elements = [Element(-1, "")]
    stack, is_open, gone = [0], Counter(), 0
    none_after: dict[str, int] = {}
    at, size = 0, len(page)

    def close(name: str) -> int:
        nonlocal gone
        while True:
            k = stack.pop()
            top = elements[k]
            is_open[top.name] -= 1
            gone -= top.gone
            if top.name == name:
                return k

    while at < size:
        start = page.find("<", at)
        if start != at:
            if not gone:
                items.append(("text", page[at : start if start >= 0 else size], stack[-1]))
            if start < 0:
                break
            at = start
        after = page[at + 1 : at + 2]
        if after == "!" or after == "?":
            mark, end = ("<!--", "-->") if page.startswith("<!--", at) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", at) else ("", ">")
            stop = page.find(end, at + len(mark))
            at = stop + len(end) if stop >= 0 else size
            continue
        m = _NAME.match(page, at)
        if not m:
            if not gone:
                items.append(("text", "<", stack[-1]))
            at += 1
            continue
        stop = _tag_end(page, at, none_after)
        piece, at, name = page[at:stop], stop, m[1].lower()
        if name not in INLINE:
            items.append(("block", "", stack[-1]))
        if after == "/":
            was = gone
            closed = close(name) if is_open[name] else stack[-1]
            if not was and name not in ("article", "main"):
                items.append(("tag", "/" + name, closed))
            continue
        if name == "p" and is_open["p"]:
            close("p")
        names, roles, hidden = _hints(piece[len(m[0]) : -1]) if len(piece) > len(m[0]) + 1 else (set(), set(), False)
        mark = 0 if names & ONE_COMMENT else 2 if name == "article" or "articlebody" in roles else int(name == "main" or "main" in roles)
        if mark and name in ("article", "main"):
            # what still holds an article was not closed
            while gone or (len(stack) > 1 and any(f in PRIOR for f in elements[stack[-1]].features) and elements[stack[-1]].name not in ("html", "body")):
                close(elements[stack[-1]].name)
        parent = elements[stack[-1]]
        within = parent.within or mark > 0 or bool(names & ARTICLE_NAMES)
        element = Element(stack[-1], name, _features(name, names, roles, within), mark, within, name in NOT_TEXT or hidden)
        lone = name in VOID or piece.endswith("/>")
        if not gone and not element.gone and name not in ("article", "main"):
            items.append(("tag", name, stack[-1] if lone or name in _RAW_END else len(elements)))
        if name in PROSE and not gone:
            for k in reversed(stack):
                if elements[k].prose:
                    break
                elements[k].prose = True
        if lone:
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        stack.append(len(elements))
        elements.append(element)
        is_open[name] += 1
        gone += element.gone
    for e in elements:
        if e.prose and e.features and e.features[0] not in PRIOR:
            e.features = (e.features[0].replace(">", " p>"), *e.features[1:])
    return items, elements


def measure(items: list[tuple[str, str, int]], elements: list[Element]) -> tuple[list[int], list[bool]]:
    """Words of each text item (they are also summed up the tree), and whether the block around an element holds mostly links.

    Paragraphs and headings are never blocks of links.
    """
    sizes = [len(value.split()) if kind == "text" else 0 for kind, value, _ in items]
    for n, (_, _, k) in zip(sizes, items, strict=True):
        elements[k].words += n
    for e in reversed(elements[1:]):
        if e.name == "a":
            e.links = e.words
        elements[e.parent].words += e.words
        elements[e.parent].links += e.links
    linked = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        linked[k] = linked[e.parent] if e.name in INLINE else e.name not in PROSE and e.words > 0 and e.links >= LINKS * e.words
    return sizes, linked


def _features(name: str, names: set[str], roles: set[str], within: bool) -> tuple[str, ...]:
    """The tag, then what class, id and role say; nothing of elements that frame a page."""
    if name in ("html", "body", "main") or (name == "article" and not names & ONE_COMMENT):
        return ()
    own = () if names & NOT_ITSELF else names - {"header"} if within or names & TITLE_NAMES else names
    tag = "" if name == "header" and within else f"<{name}>"
    return tag, *(f".{x}" for x in sorted(own)), *(f"@{x}" for x in sorted(roles))


def page_counts(page: str) -> Counter | None:
    """Words and tags inside and outside of a labelled article by feature; ``None`` if the page labels none.

    Of nested elements outside the article the outermost that holds no word of it answers for
    the words. Elements within the article whose name starts out as seldom main text don't count.
    """
    items, elements = parse(page)
    top = max((e.mark for e in elements), default=0)
    if not top:
        return None
    inside = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        inside[k] = e.mark == top or inside[e.parent]
    seen: Counter = Counter()
    sizes, linked = measure(items, elements)
    for n, (kind, value, k) in zip(sizes, items, strict=True):
        elements[k].labelled += n * inside[k]
        if kind == "tag":
            seen["tag " + value, inside[k]] += 1
            seen["tag " + placed(value, linked[k]), inside[k]] += 1
    for e in reversed(elements[1:]):
        elements[e.parent].labelled += e.labelled
    seldom = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        seldom[k] = seldom[e.parent] or any(f in PRIOR for f in e.features)
        if inside[k] and not seldom[k]:
            seen.update({(f, True): e.words for f in e.features if e.words})
        elif not inside[k] and not e.labelled and e.words and (elements[e.parent].labelled or e.parent == 0):
            seen.update({(f, False): e.words for f in e.features})
    return seen


def _count_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        total: Counter = Counter()
        for page in part.column(0).to_pylist():
            total.update((page_counts(page) if page else None) or {})
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["token", "inside", "n"])


def weigh(counts: dict[tuple[str, bool], int]) -> Weights:
    """Weights from counts inside and outside: what stands outside of articles costs, what stands inside is free."""
    def both(token: str) -> tuple[int, int]:
        return counts.get((token, True), 0), counts.get((token, False), 0)

    names = {t for t, _ in counts}
    tags = {t[4:]: -0.2 - 3.8 * (1 - (both(t)[0] + 1) / (sum(both(t)) + 2)) for t in names if t.startswith("tag ")}
    known = {t for t in names if t and not t.startswith("tag ")} | set(PRIOR)
    return Weights(tags=tags, elements={f: _weight(*both(f), PRIOR.get(f, 0.5)) for f in known})


def learn(pages: DataFrame, html_col: str = "html", max_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from labelled pages (those with ``<article>``, ``<main>`` or such a role).

    About ``max_pages`` pages at most, by the hash of the page, are read whole. Only counts by
    feature come to the driver, as many as these pages have. Without labelled pages the names
    that learning starts from decide.
    """
    small_batches(pages.sparkSession)
    html = F.col(html_col)
    rows = pages.where(html.isNotNull()).select(html.alias("html"))
    share = min(1.0, max_pages / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counts = rows.mapInArrow(_count_pages, "token string, inside boolean, n long").groupBy("token", "inside").agg(F.sum("n").alias("n"))
    return weigh({(r.token, r.inside): r.n for r in counts.collect()})


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of one page; empty if it has none.

    If nothing but elements that weigh negative holds paragraphs, one of them frames the page:
    then those that hold most of its words, and paragraphs, don't weigh, whatever their names.
    """
    if not page:
        return ""
    items, elements = parse(page)
    sizes, linked = measure(items, elements)
    text, prose = _best_run(items, elements, sizes, linked, weights, [False] * len(elements))
    if not prose:
        half = elements[0].words / 2
        frames = [e.words > half and (e.prose or not any(f in PRIOR for f in e.features)) for e in elements]
        framed, prose = _best_run(items, elements, sizes, linked, weights, frames)
        text = framed if prose or not text else text
    return text


def _best_run(items: list[tuple[str, str, int]], elements: list[Element], sizes: list[int], linked: list[bool], weights: Weights, frames: list[bool]) -> tuple[str, bool]:
    """Text of the run with the greatest sum, and whether any of it stands in a paragraph or heading."""
    score, unit, prose = [weights.word] * len(elements), [0] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        score[k] = max(LOWEST, score[e.parent] + (0.0 if frames[k] else weights.of(e, linked[k])))
        unit[k] = unit[e.parent] or (k if score[k] <= 0.0 else 0)
        prose[k] = prose[e.parent] or e.name in PROSE
    best, best_at, total, begin, last = 0.0, (0, 0), 0.0, 0, 0
    for x, (kind, value, k) in enumerate(items):
        if unit[k]:
            if unit[k] == last:
                continue
            last = unit[k]
            total += score[last] * UNIT
        elif kind == "text":
            total += sizes[x] * score[k]
        elif kind == "tag":
            total += weights.tag(value, linked[k])
        else:
            continue
        if total <= 0.0:
            total, begin = 0.0, x + 1
        elif total > best:
            best, best_at = total, (begin, x + 1)
    run = items[slice(*best_at)]
    kept = [" " if kind == "block" else value if kind == "text" and not unit[k] else "" for kind, value, k in run]
    # a reference is decoded after blocks are told apart, so what it stands for is never markup
    return " ".join(entities.unescape("".join(kept)).split()), any(kind == "text" and prose[k] and not unit[k] and value.strip() for kind, value, k in run)


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_out: str = "text") -> DataFrame:
    """Columns ``keep`` of every page and its main text.

    A null or empty page, and one without main text, give an empty text. Repeated rows give
    repeated rows; no rows give no rows; whole pages are read. A ``keep`` column named like
    the result is an error.
    """
    if text_out in keep:
        raise ValueError(f"a column is named like the result: {text_out}")
    small_batches(pages.sparkSession)
    shared, width = pages.sparkSession.sparkContext.broadcast(weights), len(keep)
    kept = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:width]), f"`{text_out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(p, shared.value) for p in part.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(texts, pa.string())], names=[*keep, text_out])

    return kept.mapInArrow(run, schema)
