import hashlib
import random
import re

from ohmlake.llm import decontaminate as D
from ohmlake.llm.decontaminate import op5_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    own = WORD.findall(lower(text))
    hit, names = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(item or "")
    return len(own), hit, sorted(names)


def test_small_cases_one_and_many_blocks(spark):
    rng = random.Random(1)
    voc = ["a", "B", "ça", "d1", "Éa", "x"]
    items = [("9", " ".join(rng.choice(voc) for _ in range(14))), ("10", "a B"), ("10", "a B"), ("3", "..."), ("4", None), (None, "Ça ÇA ça"), ("5", "x")]
    docs = [(i, "".join(rng.choice(voc) + rng.choice([" ", "--", "\n ", "  "]) for _ in range(rng.randint(0, 80)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "  ,, "), (103, items[0][1] + "! " + items[0][1]), (103, items[0][1]), (None, "A-b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "1 as n_words", "3 as window")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for bytes_ in (1 << 20, 20):
        got = D.decontaminate(df, bench, block_bytes=bytes_).collect()
        assert len(got) == len(docs)
        for r in got:
            n, hit, names = brute(r.text, items)
            assert r.n_words == n and list(r["items"]) == names
            assert {i for x in r.hit_words for i in range(x.start, x.end)} == hit
            spans = [WORD.findall(lower(r.text[x.start : x.end])) for x in r.hit_chars]
            own = WORD.findall(lower(r.text))
            assert spans == [own[x.start : x.end] for x in r.hit_words]
    assert all(r.n_words is not None and not r["items"] for r in D.decontaminate(df, bench.limit(0)).collect())
    assert D.decontaminate(df.limit(0), bench).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    rows = op5_decontaminate(spark, at).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, names = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
