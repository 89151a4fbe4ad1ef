import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ohmlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "a", "\n\n \t x", "it's we'll  IT'S", "日本語 テスト éèü ß", "\x1c\x1d a\x85b c", "a" * 3000, "abc" * 2000, "<|endoftext|>", "🙂👍🏽 é", "1234567 8½", "​﻿ x  y   z", "#$%&|<> ***", "   lead", "trail   "]


def of(ids: bytes) -> list[int]:
    return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]


def test_merges_are_the_librarys():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeth éñ日#") for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 16, 17, 40]))).encode()[: bpe.ROW] for _ in range(800)]
    words += [b"ab" * 32, b"a" * 64, b"", b"x"]
    made = bpe.merge_rows(words, bpe.vocabulary(PATH))
    for word, ids in zip(words, made):
        assert of(ids) == (LIBRARY._encode_single_piece(word) if word else [])
    for word in [w for w in words if w] + ["".join(rng.choice("theandof é") for _ in range(3000)).encode()]:
        assert of(bpe.merge_one(word, RANKS)) == LIBRARY._encode_single_piece(word)


def test_memory_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    memory = bpe.Memory(bpe.vocabulary(PATH))
    rng = random.Random(2)
    for _ in range(60):
        asked = {"".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 5, 80]))) for _ in range(3)}
        assert {x: of(y) for x, y in memory.learn(asked).items()} == {x: LIBRARY._encode_single_piece(x.encode()) for x in asked}
        assert len(memory.young) <= 6


def test_round_trip_and_odd_cases(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, None), (3, None), (None, "a b"), (1, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded", "3 as n_tokens")
    got = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert of(bytes(r.ids)) == LIBRARY.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    both = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query_is_the_librarys(spark):
    at = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    got = bpe.op1_byte_bpe(spark, at).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
