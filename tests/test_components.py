"""Connected components by blocks of edges and by steps between blocks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ohmlake.plans import components as C, storage


def least(edges):
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in up}


def test_near_nodes_are_joined_within_tasks(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(C, "stored", lambda df, name: tables.append(name) or storage.stored(df, name))
    own = spark.range(4000).select(F.concat(F.lpad((F.col("id") % 100).cast("string"), 3, "0"), F.lit("/"), F.hash("id") % 50).alias("a"), F.concat(F.lpad((F.col("id") % 100).cast("string"), 3, "0"), F.lit("/"), F.hash(F.col("id") + 1) % 50).alias("b"))
    got = {r.node: r.component for r in C.connected_components(own).collect()}
    assert got == least([(r.a, r.b) for r in own.collect() if r.a != r.b])
    assert len(tables) <= 10  # it was a table for each of several steps over all edges
    assert spark.read.parquet(*[f for f in C.connected_components(own).inputFiles()]).count() < 2 * len(got)


def test_blocks_and_links_between_them(monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(800)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2100)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([str(h) for h, _ in part]), pa.array([str(lo) for _, lo in part])], ["hi", "lo"]) for part in (edges[i : i + 50] for i in range(0, len(edges), 50))]
    monkeypatch.setattr(C, "BLOCK", 1000)
    rows = [tuple(r.values()) for b in C._rooted(iter(batches)) for r in b.to_pylist()]
    assert all(r <= n for n, r in rows) and least(rows) == least([(str(a), str(b)) for a, b in edges])
    monkeypatch.setattr(C, "BLOCK", 1 << 20)
    whole = [tuple(r.values()) for b in C._rooted(iter(batches)) for r in b.to_pylist()]
    assert dict(whole) == least([(str(a), str(b)) for a, b in edges]) and len(whole) == len(dict(whole))


def test_random_graphs_over_many_tasks(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 3000), rng.randint(0, 3000)) for _ in range(2000)] + [(9000, i) for i in range(4000, 4200)] + [(i, i + 1) for i in range(6000, 6200)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == least([e for e in edges if e[0] != e[1]])


@pytest.fixture
def many_tasks(spark):
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_what_fits_a_block_takes_no_steps(spark, monkeypatch, many_tasks):
    tables = []
    monkeypatch.setattr(C, "stored", lambda df, name: tables.append(name) or storage.stored(df, name))
    rng = random.Random(7)
    nodes = rng.sample(range(10**9), 3000)  # chains of 30 nodes each, whose order says nothing
    edges = [(a, b) for i, (a, b) in enumerate(zip(nodes[:-1], nodes[1:])) if i % 30 < 29]
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    for cast, block, most in (("long", 32 << 20, 3), ("string", 32 << 20, 3), ("long", 2000, 99)):
        tables.clear()
        monkeypatch.setattr(C, "BLOCK", block)
        got = {int(r.node): r.component for r in C.connected_components(df.select(F.col("a").cast(cast).alias("a"), F.col("b").cast(cast).alias("b"))).collect()}
        own = [(str(a), str(b)) if cast == "string" else (a, b) for a, b in edges]
        assert got == {int(n): r for n, r in least(own).items()} and len(tables) <= most  # steps write a table each
