import random

import public_tokenizers as P
import sentencepiece

from ohmlake.llm import token_counts as T

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c", "\n a\n\n  b \n", "▁x▁▁y ▁", "<s> </s> <unk> <0x0A>", "日本語 テスト", "🙂👍🏽", "tab\tand\r\ncr", "\x00\x01 x", "x" * 5000, "é" * 3000 + " ", "a b" * 3000, "​﻿   "]


def test_pre_tokens_add_up():
    rng = random.Random(2)
    assert T.splits_safely(PATH)
    for t in [x or "" for x in ODD] + ["".join(rng.choice("ab é日\n▁ 's.") for _ in range(rng.randint(0, 60))) for _ in range(500)]:
        assert sum(T.count_pieces(T.pre_tokens(t), PATH)) == len(LIBRARY.encode(t)), repr(t)


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as term", "3 as mark")
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in rows)
    for hot in (0, 3, 1 << 18):
        got = T.token_counts(df, PATH, ["doc_id"], hot=hot).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert T.token_counts(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = T.op4_token_counts(spark, at).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
