import random
import re

import numpy as np
import pyarrow as pa

from ohmlake.llm import jaccard as J, shingles
from tests.llm.plan_rows import join_rows, newest


def brute(docs, k, percent):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    sets = []
    for _, t in docs:
        w = words(t)
        m = min(k, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)], [root(i) for i in range(len(docs))], sets


def make(rng, n):
    docs, i = [], 0
    while len(docs) < n:
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 12, 30, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w) + 1)
                op = rng.random()
                if op < 0.4:
                    w.insert(at, rng.choice("xyz"))
                elif op < 0.7 and len(w) > 1:
                    w.pop(min(at, len(w) - 1))
                else:
                    w[min(at, len(w) - 1)] = rng.choice("xyz")
            docs.append((i * 7 % 100_003, " ".join(w) if rng.random() < 0.9 else "  ".join(w).upper() + "\n"))
            i += 1
    return docs


def test_against_all_pairs(spark):
    rng = random.Random(8)
    for k, percent in ((3, 90), (5, 80), (1, 50)):
        docs = make(rng, 220)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'k' as k0", "2 as items").repartition(5)
        got = J.components(df, "doc_id", k=k, percent=percent).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute(docs, k, percent)[0])


def test_odd_rows_and_one_of_each(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice("abcdefgh") for _ in range(5000))
    docs = [(None, "same here now"), (None, "same here now"), (None, "only null words here"), (None, "only null words here"), (7, None), (8, ""), (9, " \n "), (7, None), (3, "Same HERE now"), (3, "same here now"), (12, "one"), (13, "ONE"), (14, long), (15, long), (14, "other text of the same id")] + make(rng, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as _k0", "2 as component", "3 as lang")
    df = df.drop("_k0")
    want, group, sets = brute(docs, 5, 80)
    got = J.components(df, "doc_id", k=5, percent=80).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    kept = J.one_of_each(df, "doc_id").collect()
    assert kept[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    groups = {g for g, s in zip(group, sets) if s}
    assert len(kept) == len(groups) + sum(not s for s in sets)
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None and (r.text or "").split())
    assert ids == sorted(min(d for (d, _), h in zip(docs, group) if h == g and d is not None) for g in groups if any(d is not None for (d, _), h in zip(docs, group) if h == g))
    assert J.components(df.limit(0), "doc_id").count() == 0 and J.one_of_each(df.limit(0), "doc_id").count() == 0


def test_edited_copies_make_no_square(spark):
    """Copies of one text with up to a third of it edited, of which many link to none: joins make no rows for each two of them."""
    rng = random.Random(1)
    base, made = [f"w{i}" for i in range(140)], {}
    for m in (300, 1200):
        docs = []
        for i in range(m):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 8])):
                w[rng.randrange(140)] = f"x{rng.random()}"
            docs.append((i, " ".join(w)))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
        since = newest(spark)
        got = sorted(tuple(r) for r in J.components(df, "doc_id", k=5, percent=80).collect())
        made[m] = max(join_rows(spark, since))
        if m == 300:
            assert got == sorted(brute(docs, 5, 80)[0])
    assert made[1200] < 6 * made[300]


def test_cut_columns_link_as_whole_ones(spark, monkeypatch):
    """Pieces of very common columns, blocks with few partners: the same links."""
    monkeypatch.setattr(J, "PIECE", 3)
    monkeypatch.setattr(J, "PARTNERS", 2)
    rng = random.Random(5)
    for k, percent in ((3, 90), (1, 50)):
        docs = make(rng, 120) + [(200_000 + i, f"a b c d e f g h i {i % 7}") for i in range(40)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = J.components(df, "doc_id", k=k, percent=percent).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute(docs, k, percent)[0])


def test_overlaps_are_exact(spark):
    rng = random.Random(9)
    docs = make(rng, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = J.signatures(df, "doc_id", "text", 2).where("k0 is not null").withColumn("node", J.node_of("k0")).collect()
    sets = dict(zip([d for d, _ in docs], brute(docs, 2, 80)[2]))
    own = {r.node: sets[r.id] for r in rows}
    nodes = sorted(own)
    pairs = [(a, b) for a in nodes[:20] for b in nodes[20:30]]
    for r in J.overlaps(df, "text", 2, spark.createDataFrame(pairs, "a long, b long")).collect():
        pairs.remove((r.a, r.b))
        assert (r.overlap, r.size_a, r.size_b) == (len(own[r.a] & own[r.b]), len(own[r.a]), len(own[r.b]))
    assert not pairs


def test_one_order_for_all_prefixes(spark):
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(50))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[1:] * 8])], "doc_id long, text string").repartition(3)
    counts = J.occurrences(J.signatures(df, "doc_id", "text", 1).where("part is not null").select("part", "counts"))
    hashes = [h for h, _ in shingles.sets(pa.array(texts[:1]), 1, shingles.Powers())][0]
    assert sorted(counts[J.cells(hashes)].tolist()) == [1] * 250 + [10] * 50 and counts.sum() == 300 + 9 * 50
    rows = J.columns(df, "text", 1, 90, spark.sparkContext.broadcast(counts)).where("n = 300").collect()
    rows.sort(key=lambda r: r.pos)
    rare = hashes[counts[J.cells(hashes)] == 1]
    assert np.array([r.shingle for r in rows], np.int64).view(np.uint64).tolist() == rare[:31].tolist()
    assert [r.pos for r in rows] == list(range(1, 32))


def test_sets_against_python():
    rng = random.Random(3)
    pieces = ["a", "B", "ab", "\u00e9\u00c9", "\u4e2d", " ", "  ", "\n", "\t", "\x0b", "\x1f", "\u00a0", "x" * 40]
    texts = [None, "", " ", "a", "a a", "b" * 3_000_000] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    for k in (1, 3, 5):
        seen, found = {}, []
        for hashes, offsets in shingles.sets(pa.array(texts), k, shingles.Powers()):
            found += [hashes[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        want = brute(list(enumerate(texts)), k, 80)[2]
        assert len(found) == len(want)
        for have, own in zip(found, want):
            assert len(have) == len(own) and have == sorted(have)
            assert seen.setdefault(frozenset(own), have) == have
        assert len({tuple(x) for x in seen.values()}) == len(seen)


def test_sets_are_packed_in_order():
    import numpy as np

    rng = np.random.default_rng(3)
    sets_ = [np.sort(rng.integers(0, 2**64, n, np.uint64)) for n in (0, 1, 5, 0, 300, 2)]
    flat, sizes = np.concatenate(sets_), np.array([len(x) for x in sets_])
    made = J.packed(flat, sizes)
    for a, b in ((0, 6), (2, 5), (0, 1), (3, 4)):
        values, ends = J.unpacked(made.slice(a, b - a))
        assert ends.tolist() == [0, *np.cumsum(sizes[a:b]).tolist()]
        want = np.concatenate([np.zeros(0, np.uint64), *sets_[a:b]]) >> np.uint64(16) << np.uint64(16)
        assert values.tolist() == want.tolist()
