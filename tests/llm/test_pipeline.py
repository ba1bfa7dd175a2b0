"""The pipeline's stages against plain versions of what each decides."""

import base64
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomwright.llm import mixing, recipes
from loomwright.llm.prefix_bpe import read_ranks
from loomwright.llm.shared import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [docs]
    for name, stage in cp.STAGES:
        held.append(written(stage(spark, held[-1], sf_dir), name))
    first, told, once, masked, mixed, coded = held
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "personal_data", "mixture", "encoding"]
    for df in held[:-1]:
        assert df.columns == docs.columns
    # nothing in these tables is without a language
    assert told.count() == first.count()
    ids = {r.doc_id for r in once.collect()}
    from tests.llm.test_near import brute

    want = brute([(r.doc_id, r.text) for r in told.collect()], 5, 80)
    assert ids == {i for i, (_, c) in want.items() if c == i}
    before = {r.doc_id: r.text for r in once.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
    assert not any("@mail" in r.text for r in after.values()) and any("[EMAIL]" in r.text for r in after.values())
    assert all(after[i].text == t for i, t in before.items() if "@" not in t and not any(c.isdigit() for c in t))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert set(texts) <= ids
    # each document is drawn by itself: the number lies within four deviations of what the chances add up to
    chances = mixing.mix(masked.select(*cp.COLUMNS), recipes.TARGETS, recipes.topic(F.col("text"), F.col("mix_tokens"), masked=True), mixing.n_tokens(F.col("text"))).toPandas()
    p = chances.mix_probability
    assert abs(len(texts) - p.sum()) <= 4 * (p * (1 - p)).sum() ** 0.5 and p.max() == 1.0
    wanted = {k: v / sum(v for n, v in recipes.TARGETS["lang"].items() if n in set(chances.lang)) for k, v in recipes.TARGETS["lang"].items()}
    share = (chances.mix_tokens * p).groupby(chances.lang).sum() / (chances.mix_tokens * p).sum()
    assert all(abs(share[k] - wanted[k]) < 1e-3 for k in share.index)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in coded.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert bytes(got[i].ids) == np.array(library.encode_ordinary(t), "<u4").tobytes() and got[i].decoded_bytes == len(t.encode())


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_odd_documents(spark, sf_dir):
    rows = [(1, "the cat and the dog sat on the mat " * 5, "en", "src0", 10), (None, "the cat and the dog sat on a mat " * 5, None, None, None), (2, None, "en", "src0", None), (3, "", "de", "src1", 0), (4, "12 34", "de", "src1", 5), (1, "the cat and the dog sat on the mat " * 5, "en", "src0", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("gone", F.lit("own"))
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    assert docs.count() <= 3


def test_foreign_and_random_texts_go(spark, sf_dir):
    rng = random.Random(5)
    odd = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 10))) for _ in range(200)),
        " ".join(f"{rng.getrandbits(128):032x}" for _ in range(50)),
        base64.b64encode(rng.randbytes(2000)).decode(),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cp.COLUMNS)
    # each is labelled with no language, so that none is learned
    more = spark.createDataFrame([(10**9 + k, t, None, "src0", len(t)) for k, t in enumerate(odd)], docs.schema)
    told = {r.doc_id for r in cp.identify_language(spark, docs.unionByName(more), sf_dir).select("doc_id").collect()}
    assert told == {r.doc_id for r in docs.select("doc_id").collect()}
