import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmlake.llm import language as L


def test_held_out_accuracy_and_calibration(spark):
    at = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = L.op2_language_id(spark, at).collect()
    assert len(rows) == len(truth)
    right, scores = [], []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        lang, text = truth[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and lang:
            right.append(r.lang_pred == lang)
            scores.append(r.score)
    print("held-out accuracy", np.mean(right), "mean score", np.mean(scores))
    assert np.mean(right) > 0.97 and abs(np.mean(scores) - np.mean(right)) < 0.05


def test_logits_are_sums_over_ngrams():
    texts = ["Ab c!!  dÉ", "", "12 34", "z" * 40]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    n, found = L.grams(np.frombuffer(data, np.uint8), offsets)
    assert n.tolist() == [5, 0, 0, 40]
    norm = ["ab c dé", "", "", "z" * 40]
    for size, (bucket, doc) in zip(L.SIZES, found):
        assert np.bincount(doc, minlength=4).tolist() == [max(0, len(t) - size + 1) for t in norm]
        assert len(set(bucket[doc == 3].tolist())) == 1


def test_odd_rows(spark):
    rows = [(i, w * 5, lang) for i in range(60) for w, lang in (("the of and ", "en"), ("der die und ", "de"))]
    rows += [(None, "the and", "en"), (1, None, "en"), (2, "", None), (3, "123 !!", "de"), (4, "the " * 30000, None), (4, "der " * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5 as score", "'x' as lang_pred", "1 as logits")
    model = L.train_on(df)
    got = L.predict(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "und" if not r.text or r.text == "123 !!" else "en" if "the" in r.text else "de"
        assert r.lang_pred == want, r
    assert L.train_on(df.limit(0)) is None
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}
    assert L.predict(df.limit(0), model).count() == 0
    assert L.train_on(df.withColumn("lang", F.lit(None).cast("string"))) is None


def test_rare_labels_are_learned_from_a_small_sample(spark):
    rows = [(i, w * 5, lang) for i in range(4000) for w, lang in (("the of and ", "en"), ("der die und ", "de"))]
    rows += [(9000 + i, "zyx qvj wkz " * 5, "xx") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, "text", "lang", F.col("doc_id"), L.Plan(sample=200))
    assert [r.lang_pred for r in L.predict(df.where("lang = 'xx'").limit(3), model).collect()] == ["xx"] * 3


def test_too_many_labels_are_an_error(spark):
    df = spark.range(1100).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="more than 1000"):
        L.fit(df, "text", "lang", F.col("doc_id"))


def plain_counts(text):
    """Buckets of the character n-grams of a text and how often each occurs, letter by letter."""
    run = []
    for c in text or "":
        x = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32
        if x != 32 or (run and run[-1] != 32):
            run.append(x)
    counts = {}
    for n in L.SIZES:
        for i in range(len(run) - n + 1):
            h = 0
            for x in run[i : i + n]:
                h = (h * 0x01000193 + x) & 0xFFFFFFFF
            b = (((h ^ n) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - L.BITS)
            counts[b] = counts.get(b, 0) + 1
    return counts


def plain_ftrl(rows, labels, plan):
    """Weights by (bucket, label) of FTRL-proximal, one number at a time."""
    z, n = {}, {}

    def weight(b, y):
        v = z.get((b, y), 0.0)
        if abs(v) <= plan.l1:
            return 0.0
        return (math.copysign(plan.l1, v) - v) / ((plan.beta + math.sqrt(n.get((b, y), 0.0))) / plan.alpha + plan.l2)

    for _ in range(plan.epochs):
        for x, y in rows:
            w = {(b, k): weight(b, k) for b in x for k in labels}
            score = {k: sum(v * w[b, k] for b, v in x.items()) for k in labels}
            top = max(score.values())
            total = sum(math.exp(s - top) for s in score.values())
            for k in labels:
                p = math.exp(score[k] - top) / total - (k == y)
                for b, v in x.items():
                    g, old = p * v, n.get((b, k), 0.0)
                    z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / plan.alpha * w[b, k]
                    n[b, k] = old + g * g
    return {at: weight(*at) for at in z}


def test_training_and_prediction_against_plain_python(spark):
    rng = random.Random(12)
    words = {"aa": ["der", "und", "ist", "Öl"], "bb": ["the", "and", "is"], "cc": ["le", "et", "été", "Ça"]}
    docs = [(i, " ".join(rng.choice(words[y]) for _ in range(rng.randint(1, 9))) + rng.choice(["", "!", " 12 "]), y) for i, y in enumerate(rng.choice(sorted(words)) for _ in range(70))]
    docs += [(70, None, "aa"), (71, "??", "bb"), (72, "und the", None), (72, "und the et", None), (73, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    plan = L.Plan(shards=2, epochs=2)
    got = {}
    for r in L.predict(df, L.fit(df, "text", "lang", F.col("doc_id"), plan)).collect():
        got[r.doc_id, r.text] = (r.lang_pred, r.score)
    keys = {r.doc_id: r.key for r in df.select("doc_id", F.xxhash64("doc_id").alias("key")).collect()}
    train = [(keys[i], plain_counts(t), y) for i, t, y in docs if t is not None and y is not None]
    labels, n = sorted({y for _, _, y in train}), len(train)
    seen = {}
    for _, counts, _ in train:
        for b in counts:
            seen[b] = seen.get(b, 0) + 1
    idf = lambda b: math.log((1 + n) / (1 + seen.get(b, 0))) + 1
    lettered = lambda t: any(c.isalpha() for c in t or "")
    learn = [(k, counts, y) for (k, counts, y), t in zip(train, [t for _, t, y in docs if t is not None and y is not None]) if lettered(t)]
    vector = lambda counts: {**{b: L.SCALE * c / sum(counts.values()) * idf(b) for b, c in counts.items()}, L.BUCKETS: 1.0}
    shards = [sorted((k, y, c) for k, c, y in [(k, tuple(c.items()), y) for k, c, y in learn] if k % plan.calibrate and (k >> 10) % plan.shards == s) for s in range(plan.shards)]
    shards = [s for s in shards if s]
    total, weights = sum(map(len, shards)), {}
    for s in shards:
        for at, w in plain_ftrl([(vector(dict(c)), y) for _, y, c in s], labels, plan).items():
            weights[at] = weights.get(at, 0.0) + w * len(s) / total
    logit = lambda counts: [weights.get((L.BUCKETS, y), 0.0) + sum(L.SCALE * c * idf(b) * weights.get((b, y), 0.0) for b, c in counts.items()) / max(1, sum(counts.values())) for y in labels]
    held = [(logit(c), labels.index(y)) for k, c, y in learn if k % plan.calibrate == 0]

    def soft(x, t):
        top = max(x)
        e = [math.exp((v - top) / t) for v in x]
        return [v / sum(e) for v in e]

    t = min((2.0 ** (k / 8) for k in range(-32, 33)), key=lambda t: -sum(math.log(max(soft(x, t)[y], 1e-300)) for x, y in held))
    for i, text, _ in docs:
        if not lettered(text):
            assert got[i, text] == ("und", 0.0)
            continue
        p = soft(logit(plain_counts(text)), t)
        assert abs(got[i, text][1] - max(p)) < 1e-3, (i, text)
        if sorted(p)[-1] - sorted(p)[-2] > 1e-3:
            assert got[i, text][0] == labels[p.index(max(p))]
