import random
import re
from collections import Counter

from ohmlake.llm.quality import Limits, op3_repetition_quality, quality

ODD = ["", " \n\t ", "a", "one two\none two\n \n \nx", "# * $ % & | < > é", "a\x0bb\x0cc\x85d e", "x " * 50, "the end of it all now go home\n" * 9, " ".join(map(str, range(500))), "q" * 9000]


def covered(words, n):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = [False] * len(words)
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            inside[i : i + n] = [True] * n
    return inside


def brute(text, limits=Limits()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            dup += 1
            dup_chars += sum(map(len, own))
        seen.add(line)
    repeat = sum(covered(words, 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not failed and dup_chars <= 0.4 * max(chars, 1) and symbols <= len(words)
    for n, most in limits.coverage.items():
        kept = kept and sum(len(w) for w, x in zip(words, covered(words, n)) if x) / max(chars, 1) <= most
    return (len(words), chars, symbols, dup, repeat, failed, kept)


def same(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(texts[r.doc_id]), r


def test_odd_and_random_texts(spark):
    rng = random.Random(3)
    texts = dict(enumerate(ODD))
    for i in range(60):
        texts[100 + i] = "".join(rng.choice(["a", "bé", "c*", "d"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 300)))
    texts[999] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as n_words")
    same(quality(df).collect(), texts)
    assert quality(df.limit(0)).count() == 0


def test_query(spark):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = op3_repetition_quality(spark, at).collect()
    same(rows, texts)
    assert sum(r.kept for r in rows) > 0.7 * len(rows)
