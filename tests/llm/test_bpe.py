from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(9)
    pool = [chr(c) for c in range(0x250)] + [chr(c) for c in (0x301, 0x660, 0x85, 0xA0, 0x1680, 0x2003, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x4E2D, 0x1F600, 0x2167, 0x1C, 0xAD)] + [" ", "  ", "\n", "'s", "'S", "<|endoftext|>"] * 20
    return ["".join(rng.choices(pool, k=rng.randrange(1, 50))) for _ in range(1500)] + ["a" * 5000, " " * 300 + "x", "ab" * 3000, "‍\U0001f469"]


def test_equals_the_public_tokenizer(reference):
    texts = odd_texts()
    encode = bpe.encoder(bpe.tokenizer_file()).encode
    assert [encode(t) for t in texts] == reference(texts)


def test_every_entry_merges_to_itself():
    ranks = bpe.load_ranks(bpe.tokenizer_file())
    assert all(bpe.merge(piece, ranks) == [rank] for piece, rank in ranks.items())


def test_merge_against_the_plain_loop():
    ranks = bpe.load_ranks(bpe.tokenizer_file())
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choices(b"abcdeit hrsn\xc3\xa9", k=rng.randrange(1, 60)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_table(spark, reference):
    texts = ["Hello world", "", None, " \n", "Hello world", "é" * 40, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    want = dict(enumerate(reference([t or "" for t in texts]))) | {None: reference(["x"])[0]}
    assert got == want and got[1] == got[2] == []
    assert {r.doc_id: r.tokens for r in bpe.token_counts(df).collect()} == {k: len(v) for k, v in want.items()}
    assert bpe.encode(df.limit(0)).collect() == []


def test_round_trip():
    ranks = bpe.load_ranks(bpe.tokenizer_file())
    back = {v: k for k, v in ranks.items()}
    encode = bpe.encoder(bpe.tokenizer_file()).encode
    for t in odd_texts()[:400]:
        assert b"".join(back[i] for i in encode(t)).decode() == t
