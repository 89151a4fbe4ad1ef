"""Chunk operators against plain readings of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ohmlake.functions.columns import blocks_of, cut, match_spans, running_sums
from ohmlake.operators import chunks as K

HEADERS = [rf"({t})\s*:?\s*\n" for t in K.SECTION_TITLES]
WORDS = "spec Specifications ELECTRICAL characteristics Mechanical data pin configuration typical application information applications operating conditions a ñ µA 😀 voltage : = - 3.3V 5 temp icc 12°c size 3mm clock".split()


def made(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", ":\n", " : \n\n", "\x1c", " ", ". "]) for _ in range(n))


def texts(spark, rows):
    return spark.createDataFrame([(f"f{i}", t, {"m": "x"}) for i, t in enumerate(rows)], "source_file string, text string, metadata map<string,string>")


@pytest.fixture(scope="module")
def own():
    rng = random.Random(4)
    return [None, "", "spec\n", "Typical\napplication\ninformation\nx", "x" * 300, *[made(rng, rng.randint(1, 60)) for _ in range(150)], made(rng, 4000), "pin configuration\n" * 700]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 1000)]
    got = spark.createDataFrame([(r,) for r in rows], "x array<int>").select("x", running_sums(F.col("x")).alias("s")).collect()
    for r in got:
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x) + 1)]


def test_spans_are_those_of_the_regular_expression(spark, own):
    df = texts(spark, own)
    for p in [*HEADERS[:3], *K.PARAMETERS]:
        for r in df.select("text", match_spans(F.coalesce("text", F.lit("")), K._searched(p[1 : p.index(")")].split("|"), p), "").alias("s")).collect():
            assert [tuple(x) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(p, r.text or "", re.I)], p


def test_cuts(spark, own):
    long = own[-2]
    at = [(0, 5), (7, 9), (8, 8), (3, 200), (len(long) - 3, 50), (15, 1), (16, 0)]
    df = spark.createDataFrame([(long, a, n) for a, n in at], "t string, a int, n int")
    for r in df.select("*", cut(blocks_of(F.col("t"), 8), F.col("a"), F.col("n"), 8).alias("x")).collect():
        assert r.x == long[r.a : r.a + r.n]


def test_sections(spark, own):
    for r in texts(spark, own).select("text", K.sections(F.coalesce("text", F.lit(""))).alias("s")).collect():
        text = r.text or ""
        found = sorted((m.start(), m.end(), m.group(1)) for p in HEADERS for m in re.finditer(p, text, re.I))
        assert [(s.start, s.start + len(s["head"]), s.title) for s in r.s[1:]] == found
        assert "".join(s.piece for s in r.s) == text and r.s[0]["head"] == ""


def plain_semantic(text, size, overlap):
    found = sorted((m.start(), m.end(), m.group(1)) for p in HEADERS for m in re.finditer(p, text, re.I))
    out = []
    for i, (_, end, title) in enumerate(found):
        body = text[end : found[i + 1][0] if i + 1 < len(found) else len(text)].strip()
        if len(body) > 50:
            if len(body) > 2 * size:
                words = re.findall(r"\w+(?:[.,'\-/]\w+)*|[^\w\s]", body)
                out += [(title, j, " ".join(words[at : at + size])) for j, at in enumerate(range(0, len(words), size - overlap))]
            else:
                out.append((title, 0, body))
    if found and len(text[: found[0][0]].strip()) > 100:
        out.append(("Introduction", 0, text[: found[0][0]].strip()))
    return out


def test_semantic_chunks_of_any_text(spark):
    size, overlap = 40, 7
    rng = random.Random(6)  # without signs of which tokens are Java's, not Python's
    plain = [None, "", "x" * 300, *[re.sub("[^ -~\n]", " ", made(rng, rng.randint(1, 400))) for _ in range(150)]]
    got = K.semantic(texts(spark, plain), size, overlap).collect()
    want = [(f"f{i}", *x) for i, t in enumerate(plain) for x in plain_semantic(t or "", size, overlap)]
    assert sorted((r.source_file, r.section, r.chunk_index, r.text) for r in got) == sorted(want) and want


def fold(counts, size, overlap):
    done, current, length = [], [], 0
    for i, n in enumerate(counts):
        if length + n > size and current:
            done.append((current[0], current[-1] + 1))
            current = [*(current[-2:] if overlap > 0 and len(current) > 1 else []), i]
            length = sum(counts[k] for k in current)
        else:
            current.append(i)
            length += n
    return done + [(current[0], current[-1] + 1)] if current else done


def test_packing_is_the_fold(spark):
    rng = random.Random(9)
    rows = [[], [0], [99], *[[rng.randint(0, 12) for _ in range(rng.randint(1, 80))] for _ in range(200)]]
    df = spark.createDataFrame([(r,) for r in rows], "n array<int>")
    for size, overlap in ((20, 5), (20, 0), (1, 1)):
        for r in df.select("n", K.packed(F.col("n"), size, overlap).alias("p")).collect():
            assert [tuple(x) for x in r.p] == fold(r.n, size, overlap)


def test_parameters_of_any_text(spark, own):
    want = []
    for i, t in enumerate(own):
        found = [(m.group(1).lower(), m.group(2), t[max(0, m.start() - 200) : m.end() + 200]) for p in K.PARAMETERS for m in re.finditer(p, t or "", re.I)]
        want += [(f"f{i}", j, *x) for j, x in enumerate(found)]
    got = [(r.source_file, r.chunk_index, r.metadata["parameter_type"], r.metadata["parameter_value"], r.text) for r in K.parameters(texts(spark, own)).collect()]
    assert sorted(got) == sorted(want) and want


def test_no_python_in_the_plans(spark, own):
    for name in K.STRATEGIES:
        plan = K.chunked(texts(spark, ["a"]).select(F.expr("uuid()").alias("source_file"), "text", "metadata"), name)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_documents_are_dealt_over_all_tasks(spark):
    from ohmlake.queries.texts import sectioned, texts

    for made in (texts, sectioned):  # the file is one row group, so it was one task's
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_starts_of_texts_are_looked_at_without_a_search(spark):
    # RLIKE looks for a header that must be at the start at every other place, too, if there is none
    plan = K.semantic(texts(spark, ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_first_letters_with_odd_cases(spark):
    rows = ["ſpec\nx", "ſupply: 3V", "sİze = 2mm, VCC-5v", "Kind pin configuration\n", "İCC: 2a"]
    df = texts(spark, rows)
    assert [[s.head for s in r.s[1:]] for r in df.select(K.sections(F.col("text")).alias("s")).collect()] == [["ſpec\n"], [], [], ["pin configuration\n"], []]
    for p in K.PARAMETERS:
        for r in df.select("text", match_spans(F.col("text"), K._searched(p[1 : p.index(")")].split("|"), p), "").alias("s")).collect():
            assert [tuple(x) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(p, r.text, re.I)], p
