"""Chat, personal data, mixing, fingerprints and pages, against plain versions and odd inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.llm import chat, html_main, mixing, pii, queries, recipes, syncmers


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\[INST]\\\\", "[ROLE]x[:]y[/ROLE]", "[[INST]INST]", "<</s>/s>", "", "línea\n[SYS]😀", "x" * 200_000]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant"] * 5, hard, strict=True))]
    rows += [(2, 0, "tool[:]", "a"), (2, 0, None, None), (2, None, "user", "first"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 1, "user", "u"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r, t) for _, _, r, t in rows[:10]]
    assert got[1].valid and "[INST] ok" not in got[1].formatted.replace("[INST]", "", 1).split("[/INST]")[0]
    assert [(t.role, t.text) for t in got[2].back] == [("user", "first"), ("", ""), ("tool[:]", "a")]
    assert (got[3].valid, got[3].bad_turn) == (False, 2) and got[None].valid is False
    loss = out.where("conv_id = 1").select(chat.loss_text(F.col("segments"))).first()[0]
    assert loss == "".join(hard[1::2])
    assert chat.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="mark"):
        chat.Template(roles={"user": ("<<a>>", "b", False)})


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_of(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in sorted(out))


TEXTS = [
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "mail 😀é x.y+z@sub.dom.org. call +1 (743) 555-3824, +49 123", "4465758382889437 4465 7583 8288 9437 4465-7583-8288-9438 12345678901234567890",
    "000.010.255.1 1.1.1.256", "++1 234 567 89 0+", "@@a@b..c@d.e", "1" * 5000 + " 4111111111111111", "+" * 3000 + "a" * 3000 + "@", "", None, "x", "0" * 12, "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "4242 4242 4242 4242 " * 3,
    " ".join(f"u{k}@h{k}.net" for k in range(700)),
]


def test_base_spans_are_the_plain_ones(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, base string")
    out = pii.find(docs).select("doc_id", "text", "base", pii.as_text(F.col("pii_base")).alias("got"), pii.as_text(F.col("pii_spans")).alias("all"))
    for r in out.collect():
        assert r.got == base_of(r.text or ""), r.text and r.text[:60]
        assert set(r.got.split(",")) <= set(r.all.split(","))


def test_added_spans_and_masks(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(k, f'wort token = "{key[k:]}{key[:k]}" und a{k}@b.org') for k in range(20)] + [(20 + k, "nothing to see here at all") for k in range(20)] + [(50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(docs).withColumn("masked", pii.mask(F.col("text"), F.col("pii_spans"))).collect()}
    assert out[3].masked == 'wort token = "[SECRET]" und [EMAIL]' and len(out[3].pii_base) == 1
    assert out[25].masked == "nothing to see here at all" and out[50].masked is None
    empty = docs.limit(0)
    assert pii.find(empty).count() == 0
    with pytest.raises(ValueError, match="like results"):
        pii.find(docs.withColumn("pii_spans", F.lit(1)))


def test_masks_of_overlapping_spans(spark):
    texts = ["4111 1111 1111 1111.jane.doe@bank.example", "+49 170 1234567.kurt@mail.de", "a 1.2.3.4@x.y and 4111111111111111@c.d.e, +1 (743) 555-3824@z.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.masked for r in docs.select("doc_id", pii.mask(F.col("text"), F.transform(pii.base_spans(F.col("text")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))).alias("masked")).collect()}
    assert out[0] == "[CARD][EMAIL]" and out[1] == "[PHONE][EMAIL]"
    assert not any(c.isdigit() for c in out[2]) and "@" not in out[2]
    rng = random.Random(8)
    rows = []
    for k in range(200):
        text = "".join(chr(0x4E00 + i) for i in range(40))  # each character once
        spans = sorted((s, rng.randrange(4), min(40, s + rng.randrange(1, 12))) for s in (rng.randrange(40) for _ in range(rng.randrange(6))))
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, "k long, text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in df.select("k", pii.mask(F.col("text"), F.col("spans")).alias("masked")).collect():
        hidden = {c for s, _, e in rows[r.k][2] for c in rows[r.k][1][s:e]}
        assert not hidden & set(r.masked) and set(rows[r.k][1]) - hidden <= set(r.masked)


def test_long_and_dotted_keys(spark, sf_dir):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    keys = [part(201), part(20_000), f"eyJ{part(40)}.{part(90)}.{part(43)}", f"eyJ{part(40)}.e30.{part(300)}", f"SG.{part(22)}.{part(43)}", "a1" * 10 + ".b2" * 20_000]
    docs = spark.createDataFrame([(10**9 + k, f'wort token = "{x}" und so. Ende') for k, x in enumerate(keys)], "doc_id long, text string")
    spans = docs.select("doc_id", "text", pii.candidates(F.col("text"), pii.base_spans(F.col("text"))).alias("c")).collect()
    assert {r.doc_id: [r.text[x.start : x.end] for x in r.c] for r in spans} == {10**9 + k: [x] for k, x in enumerate(keys)}
    model = pii.train(pii.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(docs.where(F.col("doc_id") < 10**9 + 5))))
    out = {r.doc_id: r.masked for r in pii.find(docs, classifier=model).select("doc_id", pii.mask(F.col("text"), F.col("pii_spans")).alias("masked")).collect()}
    assert all(out[10**9 + k] == 'wort token = "[SECRET]" und so. Ende' for k in range(5))


def test_reliabilities_prefer_agreeing_labelers(spark):
    rows = [([1, 1, 1, 1, 0],)] * 80 + [([-1, -1, 0, -1, -1],)] * 60 + [([1, -1, 1, 1, 0],)] * 5 + [([-1, 1, 0, -1, -1],)] * 5
    model = pii.reliabilities(spark.createDataFrame(rows, "votes array<int>")).first().model
    assert 0.5 < model.prior < 0.65
    assert model.yes[0][2] > 0.9 > model.no[0][2] and model.yes[0][2] > model.yes[1][2]


def em_plain(seen, rounds=25):
    """``seen`` maps vote patterns to how often they occur; the plain form of the estimation."""
    import math

    prior, yes, no = 0.5, [list(r) for r in pii.FIRST_YES], [list(r) for r in pii.FIRST_NO]

    def true(v):
        return 1 / (1 + math.exp(math.log((1 - prior) / prior) + sum(math.log(no[j][v[j] + 1] / yes[j][v[j] + 1]) for j in range(5))))

    for _ in range(rounds):
        soft = {v: true(v) for v in seen}
        total, good = sum(seen.values()), sum(n * soft[v] for v, n in seen.items())
        prior = (good + 1) / (total + 2)
        yes = [[(sum(n * soft[v] for v, n in seen.items() if v[j] == x) + pii.VOTES * pii.FIRST_YES[j][x + 1]) / (good + pii.VOTES) for x in (-1, 0, 1)] for j in range(5)]
        no = [[(sum(n * (1 - soft[v]) for v, n in seen.items() if v[j] == x) + pii.VOTES * pii.FIRST_NO[j][x + 1]) / (total - good + pii.VOTES) for x in (-1, 0, 1)] for j in range(5)]
    return true


def test_op4_matches_plain_version(spark, sf_dir):
    """Base finds by plain regular expressions; added spans by plain estimation and naive Bayes over votes and features."""
    import math
    from collections import Counter
    from pathlib import Path

    sf_dir = str(Path(sf_dir).parent / "sf0.01")  # smaller tables hold no secrets
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    spans = pii.scan(docs).select("doc_id", F.explode("pii_wide").alias("x")).select("doc_id", "x.start", "x.end", "x.kind", pii.votes(F.col("x")).alias("v"), pii.features(F.col("x")).alias("f")).collect()
    true = em_plain(Counter(tuple(s.v) for s in spans))
    yes, no = Counter(), Counter()
    for s in spans:
        for f in s.f:
            yes[f] += true(s.v)
            no[f] += 1 - true(s.v)
    good = sum(true(s.v) for s in spans)

    def odds(f):
        many, ratio = yes[f] + no[f], math.log((yes[f] + 0.5) / (no[f] + 0.5))
        if not f.startswith("kind:"):
            ratio += math.log((len(spans) - good + 1) / (good + 1))
        return (many * ratio + pii.SPANS * pii.FIRST_ODDS.get(f, 0.0)) / (many + pii.SPANS)

    added = {}
    for s in spans:
        if 1 / (1 + math.exp(-sum(odds(f) for f in s.f))) >= pii.THRESHOLD:
            added.setdefault(s.doc_id, []).append((s.start, s.kind, s.end))
    assert added
    names = dict(enumerate(pii.KINDS))
    for r in queries.QUERIES["op4_weak_supervision_pii"](spark, sf_dir).collect():
        want = base_of(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in BASE)
        base = [(int(a), [*names.values()].index(k), int(e)) for k, a, e in (x.split(":") for x in want.split(",") if x)]
        assert r.spans == ",".join(f"{names[k]}:{a}:{e}" for a, k, e in sorted(base + added.get(r.doc_id, [])))


def test_planted_spans_and_decoys(spark, sf_dir):
    """Precision and recall on spans that the tables do not hold, with a model trained on the tables."""
    rng = random.Random(12)
    chars = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    hexes = lambda n: f"{rng.getrandbits(4 * n):0{n}x}"
    number = lambda: f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    call = lambda: f"{rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    yes = ['api_key = "{h40}"', "my ssn is {n}", "SSN: {n}", "call ({c} now", "phone: ({c}.", "mail me: jo.doe [at] host [dot] com", "IBAN DE89 3704 0044 0532 0130 00", "token: ghp_{k36}", "password = {k24}", "aws AKIA{K16} end", "bearer eyJ{k40}.{k60}.{k43}", "secret: sk-{k40}", "api key = {k224}"]
    no = ["isbn {n}", "ISBN 978-3-16-{d6}-0", "commit {h40}", "sha256 {h64}", "2024-quarterly-report-final-draft-v{d1}", "see file 2024-quarterly-report-final-draft-v2.pdf", "the hotel {n}", "version 1.2.{d4}", "date 2024-01-{d2}", "Donaudampfschifffahrtsgesellschaft", "https://example.com/a-very-long-path-name-2024-01-02-post", "turkey bone {d3}-{d3}-{d4}", "md5 checksum: {h32}", "of internationalisation-and-localisation there"]

    def fill(t):
        t = re.sub(r"\{h(\d+)\}", lambda m: hexes(int(m[1])), t)
        t = re.sub(r"\{k(\d+)\}", lambda m: key(int(m[1])), t)
        t = re.sub(r"\{K(\d+)\}", lambda m: key(int(m[1])).upper(), t)
        t = re.sub(r"\{d(\d+)\}", lambda m: str(rng.randint(10 ** (int(m[1]) - 1), 10 ** int(m[1]) - 1)), t)
        return t.replace("{n}", number()).replace("{c}", call())

    rows = [(k, fill(t), k % 2) for k, t in enumerate(x for pair in zip((yes * 16)[:182], (no * 13)[:182], strict=True) for x in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoy int")
    model = pii.train(pii.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    got = pii.find(docs, classifier=model).select("decoy", (F.size("pii_spans") > 0).alias("hit")).groupBy("decoy", "hit").count().collect()
    n = {(r.decoy, r.hit): r["count"] for r in got}
    found, wrong, missed = n.get((0, True), 0), n.get((1, True), 0), n.get((0, False), 0)
    assert found / (found + missed) >= 0.95 and found / (found + wrong) >= 0.95, n


def test_words_outside_all_lists_are_learned(spark):
    """What training adds: words that no list has tell true spans from others, on both sides."""
    rng = random.Random(21)
    chars = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    hexes = lambda: f"{rng.getrandbits(160):040x}"
    slug = lambda: "-".join("".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(4, 9))) for _ in range(5))
    true_words, false_words = ("kennwort", "zugang", "clave", "losung"), ("artikelnummer", "teil", "muster", "ablage")
    # what the labelers agree on stands with those words; none of the words is in a list
    listed = {*pii.AGAINST, *(w for words in pii.TRIGGERS.values() for w in words)}
    assert not listed & {*true_words, *false_words}
    rows = [(k, f"text {rng.choice(true_words)} {hexes()} ende" if k % 2 else f"text {rng.choice(false_words)} {slug()} ende") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    trained, untrained = pii.train(pii.scan(table)), pii.train(pii.scan(table.limit(0)))
    # held out: spans of 24 mixed characters, about which the labelers say little
    asked = [(k, f"text {rng.choice(true_words if k % 2 else false_words)} {key(24)} ende") for k in range(400)]
    asked += [(1000, f"text token artikelnummer {key(24)} ende"), (1001, f"text token kennwort {key(24)} ende")]
    docs = spark.createDataFrame(asked, "doc_id long, text string")
    hits = lambda model: {r.doc_id for r in pii.find(docs, classifier=model).where(F.size("pii_spans") > 0).select("doc_id").collect()}
    got, before = hits(trained), hits(untrained)
    right = {k for k, _ in asked[:400] if k % 2}
    assert len(got & right) >= 0.95 * len(right) and len(got & right) >= 0.95 * len(got - {1000, 1001})
    assert not before & right and 1001 in got
    # the untrained model goes by the listed word alone; trained, the other one weighs against it
    assert 1000 in before and 1000 not in got


def test_prefix_sums(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("s"))
    got = df.select(pii.prefix_sums(F.col("s"))).first()[0]
    assert got == [k * (k - 1) // 2 for k in range(1, 1001)]


def fit_plain(cells, targets, rounds=60):
    w = dict(cells)
    for _ in range(rounds):
        for d, goal in enumerate(targets):
            sums = {}
            for key, v in w.items():
                sums[key[d]] = sums.get(key[d], 0) + v
            total = sum(goal[c] for c in sums)
            w = {k: v * goal[k[d]] / total / sums[k[d]] for k, v in w.items()}
    return w


def test_raking_reaches_marginals(spark):
    targets = {"source": {"a": 0.5, "b": 0.3, "*": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.7, "y": 0.3}}
    rows = [(k, s, g, t, 10 + 7 * (k % 5)) for k, (s, g, t) in enumerate((s, g, t) for s in ("a", "a", "b", None, "zz") for g in ("en", "en", "de") for t in ("x", "y", "y") for _ in range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n long")
    out = mixing.mix(docs, targets, F.col("topic"), F.col("n"))
    got = out.toPandas()
    named = {"source": got.source.where(got.source.isin(["a", "b"]), "*"), "lang": got.lang, "topic": got.mix_topic}
    for key, column in named.items():
        share = (got.n * got.mix_gain).groupby(column).sum() / (got.n * got.mix_gain).sum()
        for name, want in targets[key].items():
            assert share[name] == pytest.approx(want, abs=1e-6)
    cells = got.assign(s=named["source"]).groupby(["s", "lang", "topic"]).n.sum().to_dict()
    plain = fit_plain(cells, [targets["source"], targets["lang"], targets["topic"]])
    scale = sum(cells.values()) / sum(plain.values())
    for (s, g, t), w in plain.items():
        assert got[(named["source"] == s) & (got.lang == g) & (got.topic == t)].mix_gain.iloc[0] == pytest.approx(w / cells[s, g, t] * scale, rel=1e-6)
    assert got.mix_probability.tolist() == pytest.approx((got.mix_gain / got.mix_gain.max()).tolist())
    assert 0.2 < got.mix_selected.mean() / got.mix_probability.mean() < 1.8


def test_rare_cells_keep_the_targets(spark):
    targets = {"source": {"a": 1.0}, "lang": {"en": 1.0}, "topic": {"x": 0.5, "y": 0.5}}
    # the gain of y is 10, of x 10 / 19
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("en").alias("lang"), F.when(F.col("id") % 20 == 0, "y").otherwise("x").alias("topic"))
    got = mixing.mix(docs, targets, F.col("topic"), F.lit(3).cast("long")).groupBy("topic").agg(F.sum("mix_probability").alias("p"), F.sum(F.col("mix_selected").cast("int")).alias("n")).toPandas().set_index("topic")
    assert got.p["x"] == pytest.approx(got.p["y"], rel=1e-6) and got.n["y"] == 1000 and 850 < got.n["x"] < 1150


def test_large_gains_match_sql(spark, duck):
    # documents of one source are rare, so its gain is over 10
    rows = [(k, "word " * 200, "en", "src0" if k % 40 == 0 else "src1", 1000) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = recipes.TARGETS
    got = mixing.mix(docs, targets, recipes.topic(F.col("text"), F.col("mix_tokens")), mixing.n_tokens(F.col("text"))).toPandas().sort_values("doc_id")
    assert got.mix_gain.max() > 10
    own = duck.cursor()
    own.execute("CREATE TEMP TABLE documents AS SELECT i AS doc_id, repeat('word ', 200) AS text, 'en' AS lang, CASE WHEN i % 40 = 0 THEN 'src0' ELSE 'src1' END AS source, 1000 AS n_chars FROM range(400) r(i)")
    want = own.sql(queries.ORACLES["op2_raked_mixture"]).df().sort_values("doc_id")
    assert got.mix_probability.round(6).tolist() == pytest.approx(want.probability.tolist()) and got.mix_selected.tolist() == want.selected.tolist()


def test_masked_contacts_stay_contacts(spark):
    texts = ["write to [EMAIL] now", "call [PHONE] now", "write to a@b.org", "[CARD] only"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    told = docs.select(recipes.topic(F.col("text"), F.lit(5), masked=True)).collect()
    assert [r[0] for r in told] == ["contact", "contact", "contact", "short"]


def test_mixing_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string"
    rows = [(1, "a b", "src0", "en"), (None, "c", None, None), (2, None, "src1", "de"), (3, "  ", "src1", "de"), (1, "a b", "src0", "en")]
    for part, n in ((rows, 5), ([], 0), (rows[2:4], 2)):
        docs = spark.createDataFrame(part, schema).withColumn("gain", F.lit("own"))
        out = mixing.mix(docs, recipes.TARGETS, recipes.topic(F.col("text"), F.col("mix_tokens")), mixing.n_tokens(F.col("text"))).collect()
        assert len(out) == n and all((r.mix_probability > 0) == (r.mix_tokens > 0) and r.gain == "own" for r in out)
    with pytest.raises(ValueError):
        mixing.calibrate(docs, F.col("source"), F.col("lang"), F.lit("x"), F.lit(1), {"source": {"a": -1.0}, "lang": {}, "topic": {}})


def hash_table(spark, parts):
    rows = spark.createDataFrame([(p,) for p in sorted(parts)], "p string").select("p", F.xxhash64("p").alias("h")).collect()
    return {r.p: r.h for r in rows}


def prints_plain(spark, texts, k=syncmers.K, s=syncmers.S):
    """Fingerprints of some texts, one k-mer after the other."""
    h = hash_table(spark, {t[i : i + s] for t in texts for i in range(len(t) - s + 1)})
    found, keys = {}, set()
    for t in set(texts):
        found[t] = []
        for i in range(len(t) - k + 1):
            inner = [h[t[i + j : i + j + s]] for j in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                found[t].append((i, tuple(h[t[i + j : i + j + s]] for j in range(0, k, s))))
                keys.add(found[t][-1][1])
    named = {}
    if keys:
        cols = [f"c{j}" for j in range(k // s)]
        rows = spark.createDataFrame(sorted(keys), ", ".join(f"{c} long" for c in cols)).select(*cols, F.xxhash64(*cols).alias("h")).collect()
        named = {tuple(r[c] for c in cols): r.h for r in rows}
    short = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {*texts, "x"}], "t string").select("t", F.xxhash64("t", F.lit(k)).alias("h")).collect()}
    return {t: [(i, named[x]) for i, x in f] if len(t) >= k else [(0, short[t])] if t else [] for t, f in found.items()}


def likeness_plain(a, b):
    feature = lambda p: {x for _, x in p} | {(x, j - i, y) for (i, x), (j, y) in zip(p, p[1:], strict=False)}
    a, b = feature(a), feature(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    words = " ".join(f"w{(k * k) % 97}" for k in range(400))
    moved = "ein anderer anfang " + words
    df = spark.createDataFrame([(words, moved)], "a string, b string")
    row = df.select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b")).first()
    # context-free: the same k-mers are chosen behind another beginning, nineteen places later
    assert {(x["at"], x["hash"]) for x in row.a} == {(x["at"] - 19, x["hash"]) for x in row.b if x["at"] >= 19}
    # closed syncmers leave no long gap
    at = [x["at"] for x in row.a]
    assert max(b - a for a, b in zip(at, at[1:], strict=False)) <= syncmers.K - syncmers.S
    with pytest.raises(ValueError):
        syncmers.anchors(F.col("a"), 10, 4)


@pytest.mark.parametrize(("k", "s"), [(24, 6), (9, 3)])
def test_anchors_are_the_plain_ones(spark, k, s):
    rng = random.Random(k)
    texts = ["", " ", "x", "x" * 300, "ab" * 100, "😀é中 " * 30, "k" * (k - 1), "k" * k] + ["".join(rng.choice("abc äß😀") for _ in range(rng.randint(1, 4 * k))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", syncmers.fingerprint(F.col("text"), k, s).alias("f"))
    want = prints_plain(spark, texts, k, s)
    for r in df.collect():
        assert [(x["at"], x["hash"]) for x in r.f] == want[r.text or ""]


def test_op7_matches_plain_version(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op7_closed_syncmers"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    edited = {}
    for k, (i, t) in enumerate(docs):
        cut = len(t) // 3
        edited[i] = t[: len(t) - cut] + docs[(k + 1) % len(docs)][1][:cut]
    prints = prints_plain(spark, [t for _, t in docs] + [*edited.values()])
    text = lambda p: " ".join(f"{a:x}:{h & (2**64 - 1):x}" for a, h in p)
    for k, (i, t) in enumerate(docs):
        r, mine, new, after = got[i], prints[t], prints[edited[i]], prints[docs[(k + 1) % len(docs)][1]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (text(mine), text(new))
        assert r.near_edited == pytest.approx(likeness_plain(mine, new)) and r.near_next == pytest.approx(likeness_plain(mine, after))
        # an edit leaves two thirds: only texts that keep no whole k-mer share nothing
        assert r.near_edited > 0 or len(t) - len(t) // 3 < 2 * syncmers.K


def test_edits_and_next(spark):
    rows = [(k * 1500, " ".join(f"d{k}w{j}" for j in range(60))) for k in range(7)] + [(3, None), (5, ""), (7, "ab"), (None, "lost one here"), (7, "ab"), (8, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, fingerprint string")
    got = sorted(syncmers.compare_with_edits(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        cut, new = len(t) // 3, order[(k + 1) % len(order)][1]
        want.append((i, t[: len(t) - cut] + new[:cut], len(t)))
    assert sorted((str(r.doc_id), r.edited, r.n_chars) for r in got) == sorted((str(i), e, n) for i, e, n in want)
    one = [r for r in got if r.doc_id == 1500][0]
    assert 0.3 < one.near_edited < 0.7 and one.near_next == 0.0
    alone = syncmers.compare_with_edits(docs.where("doc_id = 0")).first()
    assert alone.near_next == 1.0 and syncmers.compare_with_edits(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav>
<div id="cookie-notice">We use cookies on this site okay</div><{open}><h1>Real &amp; title</h1><p>First para with <b>bo</b>ld words<br>and more &lt;b&gt; text here.
<div class="ad">Buy now</div><aside>Related stuff</aside><script>var x = "<p>no</p>";</script><p>Second&nbsp;paragraph   goes on.</p><form><input>Mail</form></{close}>
<section id="comments"><p>Nice article I like it</p></section><footer>Foot words &copy; here</footer></body></html>"""


@pytest.mark.parametrize(("open_", "close"), [("article", "article"), ('div class="post-body"', "div"), ("main", "main")])
def test_page(open_, close):
    page = PAGE.replace("{open}", open_).replace("{close}", close)
    assert html_main.main_text(page, html_main.Weights()) == "Real & title First para with bold words and more <b> text here. Second paragraph goes on."


@pytest.mark.parametrize("page", [None, "", "<p>", "plain words only", "<div><<<", "<script>never closed", "<nav>menu</nav>", "<!-- x", "<a href='unclosed", "<p>" * 3000 + "deep", "<b \"" * 20_000])
def test_odd_pages(page):
    text = html_main.main_text(page, html_main.Weights())
    assert text == {"plain words only": "plain words only"}.get(page, text) and "never" not in text and "menu" not in text


def test_attributes_of_any_length():
    weights = html_main.Weights()
    for n in (3, 3000, 300_000):
        for quote in "\"'":
            page = f"<nav>menu</nav><article><p>Some words <img alt={quote}{'x>' * n}{quote}> and more of them</p></article>"
            assert html_main.main_text(page, weights) == "Some words and more of them"
    # a quote that stands open ends with its tag
    assert html_main.main_text("<p class='x>one two</p><p>three</p>", weights) == "one two three"


WORDS = [f"w{k}" for k in range(400)]


@pytest.fixture(scope="module")
def learned():
    """Weights of the pages of the tables, as far as tests have them."""
    from collections import Counter
    from pathlib import Path

    import pyarrow.parquet as pq

    from tests.conftest import DATA

    seen = Counter()
    for r in pq.read_table(Path(DATA).parent / "sf0.01" / "pages.parquet").to_pylist():
        seen.update(html_main.page_counts(r["html"]))
    return html_main.weigh(dict(seen))


@pytest.mark.parametrize("more", [
    '<aside class="sidebar"><h2>More</h2>{p}</aside>', "<footer>{p}</footer>", '<div class="cookie-notice">{p}</div>', '<section id="comments">{p}</section>', '<div class="newsletter">{p}<form><input></form></div>',
])
@pytest.mark.parametrize("first", [True, False])
def test_boilerplate_longer_than_the_article(learned, more, first):
    article = "<article><h1>A title</h1><p>" + " ".join(WORDS[:50]) + "</p></article>"
    other = more.replace("{p}", "".join(f"<p>{' '.join(WORDS[k : k + 40])}</p>" for k in range(100, 300, 40)))
    page = f"<html><body>{other + article if first else article + other}</body></html>"
    for weights in (learned, html_main.Weights()):
        assert html_main.main_text(page, weights) == "A title " + " ".join(WORDS[:50])


@pytest.mark.parametrize("item", ["<ul>{}</ul>|<li>{}</li>", "<ol>{}</ol>|<li>{} and more words</li>", "{}|<p><a href='/x'>{}</a></p>", "{}|<p>See <a href='/x'>{}</a> there.</p>", "<table>{}</table>|<tr><td>{}</td><td>v</td></tr>", "{}|<h2>{}</h2><p>Text.</p>"])
def test_articles_of_lists_and_links(learned, item):
    outer, one = item.split("|")
    rows = [one.format(w) for w in WORDS[:12]]
    page = f"<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article>{outer.format(''.join(rows))}</article><footer>Foot words</footer></body></html>"
    want = " ".join(" ".join(re.sub("<[^>]*>", " ", r).split()) for r in rows)
    want = want.replace(" there .", " there.")
    for weights in (learned, html_main.Weights()):
        assert html_main.main_text(page, weights) == want


def test_a_frame_of_any_name(learned):
    page = f"<html><body><div class='sidebar-layout banner'><nav><a href=/>Home</a></nav><div><h1>A title</h1><p>{' '.join(WORDS[:60])}</p></div><footer>Foot words</footer></div></body></html>"
    assert html_main.main_text(page, learned) == "A title " + " ".join(WORDS[:60])


def article_of(page):
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))).split())


def f1_of(got, want):
    from collections import Counter

    got, want = Counter(got.split()), Counter(want.split())
    return 2 * sum((got & want).values()) / max(1, sum(got.values()) + sum(want.values()))


def test_learned_weights_find_unmarked_articles(sf_dir):
    """Held-out pages without marks, classes, ids and roles; what is learned decides."""
    from collections import Counter
    from pathlib import Path

    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table(Path(sf_dir).parent / "sf0.01" / "pages.parquet").to_pylist()]
    seen = Counter()
    for page in pages[::2]:
        seen.update(html_main.page_counts(page))
    score = {}
    for name, weights in (("learned", html_main.weigh(dict(seen))), ("start", html_main.Weights()), ("none", html_main.Weights(elements={}))):
        bare = [(re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub("(</?)article>", rf"\1{tag}", p)), article_of(p)) for p in pages[1::2] for tag in ("div>", "x>")]
        score[name] = sum(f1_of(html_main.main_text(p, weights), want) for p, want in bare) / len(bare)
    assert score["learned"] >= 0.99 and score["start"] < 0.985 and score["none"] < 0.96


def test_extraction_keeps_rows(spark):
    rows = [(1, "<p>hello there</p>", "own"), (1, "<p>hello there</p>", "own"), (None, None, "own")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("url", F.lit("u"))
    assert sorted(r.text for r in html_main.extract(pages, html_main.learn(pages)).collect()) == ["", "hello there", "hello there"]
    with pytest.raises(ValueError, match="like the result"):
        html_main.extract(pages, html_main.Weights(), keep=("page_id", "text"))


def test_pages_of_the_tables(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op10_max_run_extraction"](spark, sf_dir).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))).split())
        assert got[k].text == want and got[k].n_chars == len(want)
    few = spark.createDataFrame([(1, None, "own"), (None, "<p>hello there</p>", "own")], "page_id long, html string, text string").withColumn("url", F.lit(None).cast("string"))
    weights = html_main.learn(few)
    assert sorted(r.text for r in html_main.extract(few, weights).collect()) == ["", "hello there"]
    assert html_main.extract(few.limit(0), html_main.learn(few.limit(0))).count() == 0
