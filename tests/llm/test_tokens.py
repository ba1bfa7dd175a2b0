"""BPE, token counts and language identification against the libraries, with odd inputs."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import lang_id, pretokens, queries, token_counts
from loomwright.llm.prefix_bpe import PrefixBpe, encode_decode, read_ranks

PIECES = ["a", "th", "er", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "'s", "1", "23", "...", "!!", "\xa0", "\x1c", "\x85", "​", "　", "ing", "́", "²", "<|endoftext|>", "zz"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def bpe(ranks):
    return PrefixBpe(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=300, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoding_is_the_librarys(bpe, library):
    split = pretokens.splitter(public_tokenizers.PATTERN)
    for t in [*texts(2000), "a" * 5000, "ab" * 3000, " " * 3000, "Grüße, naïve!"]:
        assert [i for p in split(t) for i in bpe.encode_piece(p.encode())] == library.encode_ordinary(t)


def test_append_and_edit(bpe):
    rng = random.Random(8)
    data = bytes(rng.choice(b"theringansto ") for _ in range(400))
    whole = bpe.extend(data, [])
    grown = bpe.extend(data, bpe.extend(data[:150], []))
    assert grown == whole and b"".join(bpe.token[t] for t in bpe.tokens(whole)) == data
    new, last = bpe.edit(data, list(whole), 100, 120, b"ing the")
    assert last == bpe.extend(new, []) and new == data[:100] + b"ing the" + data[120:]


def test_edits_stop_where_entries_coincide(bpe):
    rng = random.Random(9)
    data = bytes(rng.choice(b"theringansto ") for _ in range(3000))
    whole = bpe.extend(data, [])
    for _ in range(30):
        at = rng.randrange(len(data))
        stop, put = min(len(data), at + rng.randrange(9)), bytes(rng.choice(b"abe ") for _ in range(rng.randrange(6)))
        new, last = bpe.edit(data, list(whole), at, stop, put)
        assert new == data[:at] + put + data[stop:] and last == bpe.extend(new, [])
    steps = []
    bpe.extend = lambda data, last, stop=None: (steps.append(1), type(bpe).extend(bpe, data, last, stop))[1]
    try:
        bpe.edit(data, list(whole), 5, 6, b"x")
    finally:
        del bpe.extend
    assert len(steps) < 1000


def test_cache_halves(bpe, library, monkeypatch):
    from loomwright.llm import prefix_bpe

    monkeypatch.setattr(prefix_bpe, "CACHE", 5)
    pieces = prefix_bpe._Pieces(bpe)
    words = [f" w{k % 13}" for k in range(100)]
    assert b"".join(map(pieces.__getitem__, words)) == np.array(library.encode_ordinary("".join(words)), "<u4").tobytes()
    assert len(pieces) <= 6 and len(pieces.older) <= 6


def test_encode_decode_rows(spark, ranks, library):
    rows = [(k, t) for k, t in enumerate([*texts(60), None, "", "wort " * 20_000])] + [(0, "twice"), (0, "twice"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("own"))
    got = encode_decode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.ids) == np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode_decode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="like results"):
        encode_decode(docs.withColumn("ids", F.lit(1)), ranks, public_tokenizers.PATTERN, keep=("ids",))


def test_counts_are_the_librarys(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        content = file.read()
    rows = [(k, t) for k, t in enumerate([*texts(200), None, "", "<|endoftext|>", "wort " * 30_000, "x" * 4000])] + [(0, "again"), (0, "again"), (None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(1)).withColumn("base", F.lit(2))
    tok = Tokenizer.from_file(path)
    want = sorted(((i if i is not None else -1), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for head in (0, 50, 200_000):
        got = token_counts.count_tokens(docs, content, public_tokenizers.PATTERN, head_size=head)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(docs.limit(0), content, public_tokenizers.PATTERN).count() == 0


def test_queries_of_tokens(spark, sf_dir, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9(spark, sf_dir).collect():
        ids = library.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
    counts = queries.op8(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {i: len(library.encode_ordinary(t)) for i, t in rows.items()}
    assert all(r.over_limit == (r.n_tokens > 512) for r in counts)


def test_languages(spark):
    train = spark.createDataFrame([("en", "the cat and the dog 1"), ("en", "the house and the cat"), ("de", "der hund und die katze"), ("de", "das haus und der hund"), (None, "zzz"), ("fr", None)], "lang string, text string")
    model = lang_id.fit(train)
    assert model.langs == ["de", "en"]
    rows = [(1, "the cat"), (2, "DER HUND"), (3, "hunde"), (4, "catty"), (5, None), (6, ""), (7, "123 ²!"), (8, "中文"), (1, "the cat"), (9, "the " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(docs, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 9)] == ["en", "de", "de", "en", "en"]
    assert [got[k] for k in (5, 6, 7)] == [("und", 0.0)] * 3
    assert got[8][0] in model.langs and all(0 <= s <= 1 for _, s in got.values())
    assert lang_id.identify(docs.limit(0), model).count() == 0
    empty = lang_id.fit(train.limit(0))
    assert {r.lang_pred for r in lang_id.identify(docs, empty).collect()} == {"und"}


def test_language_accuracy_on_held_out(spark, sf_dir):
    told = queries.op6(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [(r.lang, r.lang_pred) for r in told.where("held_out").collect()]
    assert len(rows) > 20 and sum(a == b for a, b in rows) / len(rows) >= 0.97


def test_language_scores_are_the_plain_ones(spark, sf_dir):
    """op6 of whole tables against counting and scoring strings one after the other."""
    import math
    import zlib
    from collections import Counter

    import regex

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    orders = (5, 4, 3, 2, 1)

    def words_of(text):
        return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())

    def grams(word, order):
        marked = word if order == 1 else f"_{word}_"
        return [marked[k : k + order] for k in range(len(marked) - order + 1)]

    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    seen = {o: Counter() for o in (0, *orders)}
    for d in docs:
        if not held[d.doc_id] and d.lang is not None and d.text is not None:
            for w in words_of(d.text):
                seen[0][w, d.lang] += 1
                for o in orders:
                    seen[o].update((g, d.lang) for g in grams(w, o))
    langs = sorted({lang for _, lang in seen[0]})
    log = {}
    for o, counts in seen.items():
        total = {x: max(1, sum(n for (_, lang), n in counts.items() if lang == x)) for x in langs}
        units = {u for u, _ in counts}
        floor = 0.5 / max(total.values())
        log |= {(o, u): [math.log((counts[u, x] / total[x] + floor) / (1 + floor * (len(units) + 1))) for x in langs] for u in units}

    kept = {}

    def score(word):
        if word not in kept:
            kept[word] = log.get((0, word)) or next(([sum(c) / len(c) for c in zip(*found, strict=True)] for o in orders if (found := [log[o, g] for g in grams(word, o) if (o, g) in log])), [0.0] * len(langs))
        return kept[word]

    rows = {r.doc_id: r for r in queries.op6(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        got, words = rows[d.doc_id], words_of(d.text)
        assert got.held_out == held[d.doc_id]
        if not words:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        mean = [sum(c) / len(words) for c in zip(*map(score, words), strict=True)]
        odds = [math.exp((m - max(mean)) * min(len(words), 20)) for m in mean]
        assert got.score == pytest.approx(1 / sum(odds), abs=2e-3)
        if sorted(mean)[-1] - sorted(mean)[-2] > 1e-4:
            assert got.lang_pred == langs[mean.index(max(mean))]
