import random
import re

import pytest

from ohmlake.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, index, templates=L.TEMPLATES):
    own = words(text)
    stands = lambda at, phrase: at >= 0 and own[at : at + len(phrase)] == phrase
    places = sorted((i, label) for p, label in L.PHRASES for i in range(len(own)) if stands(i, p.split()))
    found, there = set(), set(own)
    for (label, text_, key), indexed in zip(templates, index):
        whole, key = text_.split(), key.split()
        k = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        rare = [x for x in indexed if x[0] in there][: L.RARE]
        if len(rare) < L.ENOUGH:
            continue
        for at in range(-len(whole), len(own)):
            hits = [0 <= at + p < len(own) and own[at + p] == w for w, p, _ in rare]
            if sum(hits) >= L.ENOUGH and stands(at + k, key):
                found.add((at, label, round(sum(x for h, (_, _, x) in zip(hits, rare) if h) / sum(x for _, _, x in rare), 9)))
    labels = sorted({x for _, x in places} | {x[1] for x in found})
    score = 1.0 if places else max([0.0, *(x[2] for x in found)])
    return len(own), places, sorted(found), labels, score


def same(rows, texts, index):
    for r in rows:
        n, places, found, labels, score = brute(texts[r.k], index)
        assert r.n_words == n and [tuple(x) for x in r.places] == places
        assert [(x.start, x.label, round(x.score, 9)) for x in r.templates] == found
        assert list(r.labels) == labels and abs(r.score - score) < 1e-9


def test_against_a_plain_scan(spark):
    rng = random.Random(6)
    texts = [None, "", " . ", "cc by nc cc by nc cc-BY-NC", "UNDER THE MIT LICENSE", "the mit license under the mit license", "Apache License, Version 2.0 é", "mit " * 3000, "under the mit license " * 400]
    texts += [t for _, t, _ in L.TEMPLATES] + ["x " + t.replace("the", "a") + " y" for _, t, _ in L.TEMPLATES] + [t.upper().replace(" ", "\n* ") for _, t, _ in L.TEMPLATES]
    pool = " ".join(t for _, t, _ in L.TEMPLATES).split()
    for _ in range(40):
        own = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice([t for _, t, _ in L.TEMPLATES] + [p for p, _ in L.PHRASES]).split()
            a = rng.randrange(len(t))
            own += t[a:] if rng.random() < 0.3 else t
            own += [rng.choice(pool) for _ in range(rng.randint(0, 20))]
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").selectExpr("*", "1 as labels", "2 as _words", "'q' as score")
    idf = L.idf_of(df, "text", sorted({w for _, t, _ in L.TEMPLATES for w in t.split()}))
    index = L.index_of(idf)
    rows = L.scan(df).collect()
    assert len(rows) == len(texts)
    same(rows, texts, index)
    by = {r.k: r.labels for r in rows}
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in by[9 + i]
    assert L.scan(df.limit(0)).count() == 0


def test_many_templates_of_the_caller(spark):
    """500 templates, some of whose words share a slot or stand in many of them; only those with enough words in a file are looked at."""
    rng = random.Random(66)
    pool = [f"w{i}" for i in range(900)] + ["é", "日本", "software"]
    templates = []
    for k in range(500):
        whole = rng.choices(pool, k=rng.randint(3, 25))
        a = rng.randrange(len(whole) - 1)
        templates.append((f"l{k % 200}", " ".join(whole), " ".join(whole[a : a + rng.randint(1, 4)])))
    texts = [None, "", "software " * 500]
    for _ in range(60):
        own = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(templates)[1].split()
            own += [w if rng.random() < 0.95 else "x" for w in t] + rng.choices(pool, k=rng.randint(0, 30))
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    index = L.index_of(L.idf_of(df, "text", sorted({w for _, t, _ in templates for w in t.split()})), templates)
    rows = L.scan(df, index=index, templates=templates).collect()
    assert len(rows) == len(texts) and sum(len(r.templates) for r in rows) > 30
    for r in rows:
        n, places, found, labels, score = brute(texts[r.k], index, templates)
        assert r.n_words == n and [(x.start, x.label, round(x.score, 9)) for x in r.templates] == found
        assert list(r.labels) == labels and abs(r.score - score) < 1e-9
    none = L.scan(df, templates=[]).collect()
    assert all(len(r.templates) == 0 and r.score == 0 for r in none)
    with pytest.raises(ValueError):
        L.scan(df, templates=[("a", "one two three", "four")])
    plan = L.scan(df, index=index, templates=templates)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan  # the index is a constant


def test_query_has_no_python(spark):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    df = L.op6_license_scan(spark, at)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = words(texts[r.doc_id])
        starts = sorted((i, label) for p, label in L.PHRASES for i in range(len(own)) if own[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(own), len(starts))
        assert (r.first_word, r.last_word) == ((starts[0][0], starts[-1][0]) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in starts})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        if "GNU General Public License, version 3" in (texts[r.doc_id] or ""):
            assert "gpl-3" in r.labels
