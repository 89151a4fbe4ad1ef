import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from ohmlake.llm import lattice as L

PATH = P.path("piece_bpe_32k.model")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def segmentations(text, known):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in known or n == 1:
            for rest in segmentations(text[n:], known):
                yield [text[:n], *rest]


def test_recursion_is_the_sum_over_segmentations():
    rng = np.random.default_rng(0)
    lat = L.Lattice(PATH, np.log(rng.random(32_000) / 16_000))
    for word in ("the", "thereon", "xé", "日本", "a🙂b", "q"):
        total = 0.0
        for parts in segmentations("▁" + word, lat.log_p):
            total += math.exp(sum(lat.log_p[p] if p in lat.log_p else sum(lat.bytes[b] for b in p.encode()) for p in parts))
        assert math.isclose(lat.log_word(word), math.log(total), rel_tol=1e-12)
    assert lat.log_word("ab" * 20_000) < -1000


def check(rows, docs):
    train = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t)))
    n, v = sum(counts.values()) + len(train), len(counts) + bool(train)
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    want = []
    for i, t in docs:
        own = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        want.append((-1 if i is None else i, len(own) + 1, sum(counts[w] > 0 for w in own) + bool(train), n, sum(base(counts[w]) for w in own) + base(len(train))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9), (a, b)


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(["The cat", "the CAT sat\x85on", None, "", " \n", "É é\x1cx", "w" * 4000, "cat " * 500, "a b c", "a b c d"])]
    docs += [(3, "the cat"), (3, "the cat"), (None, "dog the"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as n", "3 as term")
    for hot in (0, 4, 1 << 18):
        rows = L.score(df, PATH, ["doc_id"], L.crc_mod("doc_id", 7) != 2, hot=hot).collect()
        check(rows, docs)
        assert all(r.score < 0 for r in rows)
    assert L.score(df.limit(0), PATH, ["doc_id"], F.lit(True)).count() == 0
    none = L.score(df, PATH, ["doc_id"], F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.base_score for r in none} == {0.0}


def test_query_and_that_the_model_learns(spark):
    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    rows = L.op10_lattice_scores(spark, at).collect()
    check(rows, docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    chars = {i: len(t) for i, t in docs}
    held = [r for r in rows if r.held_out]
    bits = -sum(r.score for r in held) / sum(chars[r.doc_id] for r in held) * math.log2(10)
    flat = L.Lattice(PATH, np.full(32_000, -math.log(32_000)))
    even = -sum(flat.log_word(w) for i, t in docs if any(r.doc_id == i for r in held) for w in L.words(t)) / sum(chars[r.doc_id] for r in held) / math.log(2)
    assert bits < 0.9 * even
