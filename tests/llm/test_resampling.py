import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from ohmlake.llm import resampling as R
from ohmlake.llm.common import slices
from ohmlake.llm.resampling import op13_importance_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, most=2):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return own, [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, percent=25, least=20, buckets=10000, most=2, seed=7):
    """docs: (id, text); rows as the operator's, sorted by id and features."""
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, rows in ((s, [x for _, x in docs]), (t, target)):
        for text in rows:
            for g in grams(text, most)[1]:
                counts[crc(g)] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (S + buckets) / ((int(a) + 1) * (T + buckets)))) for a, b in zip(s, t)]
    rows = []
    for id_, text in docs:
        words, found = grams(text, most)
        weight = sum(gain[crc(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append([id_, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def test_runs_of_any_length_by_two_prefixes():
    rng = random.Random(3)
    long = ["".join(rng.choice("abé9") for _ in range(n)) for n in (1, 200, 255, 256, 300, 70_000)]
    texts = ["", None, "?? !", "one", "A-b  c", " ".join(rng.choice(long) for _ in range(30)), *[" ".join(rng.choice("a bb Ccc ñ 7".split()) for _ in range(rng.randint(0, 9))) for _ in range(30)]]
    for most in (1, 2, 5):
        got, counts = [[] for _ in range(most)], []
        for data, offsets in slices(pa.array(texts), 40):
            n, runs = R.crcs(data, offsets, most)
            counts += n.tolist()
            for k, (crc, each) in enumerate(runs):
                for a, b in zip(np.cumsum(each) - each, np.cumsum(each)):
                    got[k].append(crc[a:b].tolist())
        for i, text in enumerate(texts):
            words, _ = grams(text)
            assert counts[i] == len(words)
            for n in range(1, most + 1):
                assert got[n - 1][i] == [zlib.crc32(" ".join(words[j : j + n]).encode()) for j in range(len(words) - n + 1)]


def test_small_cases(spark):
    rng = random.Random(5)
    voc = "one two Three four vier ça x1 y".split()
    text = lambda n: " ".join(rng.choice(voc) + rng.choice(["", ",", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "-- !"), (7, docs7 := text(40)), (7, docs7), (7, text(30)), (None, text(25))]
    target = [text(9), None, "", "one two three one two"]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as weight", "2 as rank", "'x' as bucket")
    aim = spark.createDataFrame([(x,) for x in target], "text string").selectExpr("*", "1 as features")
    for percent, buckets, most in ((25, 10000, 2), (100, 7, 3), (0, 50, 1)):
        got = R.resampled(df, aim, percent=percent, buckets=buckets, most=most)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, percent, 20, buckets, most)
    assert R.resampled(df.limit(0), aim).count() == 0
    assert sorted(map(tuple, R.resampled(df, aim.limit(0)).collect()), key=str) == brute(docs, [])


def test_one_text_in_most_rows_is_ranked_over_many_scores(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'a b c d e f g h i j k l m n o p q r s t u v w' as text")
    rows = R.resampled(df, df.limit(1).select("text"))
    assert sorted(r[0] for r in rows.where("rank is not null").select("rank").collect()) == list(range(1, 751))
    assert rows.groupBy("score").count().agg({"count": "max"}).first()[0] < 12


def test_query(spark):
    at = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    got = op13_importance_resampling(spark, at)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    want = sorted(((a, c, d, e, f) for a, _, c, d, e, f in brute(docs, target)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[4] for r in want)
