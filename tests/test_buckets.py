"""Upserts by buckets: what they write, what readers see, and writers that meet."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ohmlake.plans import buckets as B


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_against_a_dictionary(spark, tmp_path):
    rng, at = random.Random(2), str(tmp_path / "t")
    held = {(i, "x" if i % 3 else None): i for i in range(400)}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d], "id long, part string, value long")
    B.create(frame(held.items()), at, ["id", "part"], 16)
    for _ in range(4):
        new = [((rng.randrange(500), rng.choice(["x", None, "y"])), rng.randrange(10**6)) for _ in range(30)]
        B.upsert(frame(new), at)
        best = {}
        for k, v in new:
            best[k] = max(v, best.get(k, v))
        held |= best
        assert rows(B.read(spark, at)) == sorted(((*k, v) for k, v in held.items()), key=str)
    assert B.manifest(spark, at)["version"] == 5 and B.upsert(frame([]), at) == []


def test_bytes_are_in_proportion_and_a_second_run_writes_the_same(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    B.create(df, at, ["id"], 64)
    before = size(at)
    new = spark.range(3).select("id", F.lit("new").alias("text"))
    touched = B.upsert(new, at)
    written = size(at) - before
    assert len(touched) <= 3 and written < before * len(touched) / 64 * 2
    first = rows(B.read(spark, at))
    assert B.upsert(new, at) == touched and rows(B.read(spark, at)) == first
    assert B.vacuum(spark, at) >= 1 and rows(B.read(spark, at)) == first and len(first) == 20_000


def test_a_reader_sees_its_version_and_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    B.create(old, at, ["id"], 4)
    reader = B.read(spark, at)
    B.upsert(spark.createDataFrame([(1, "c")], "id long, text string"), at)
    assert rows(reader) == [(1, "a"), (2, "b")] == rows(B.read(spark, at, 1)) and rows(B.read(spark, at)) == [(1, "c"), (2, "b")]
    stale = B.manifest(spark, at, 1)
    monkeypatch.setattr(B, "manifest", lambda *a: dict(stale))
    with pytest.raises(ValueError):
        B.upsert(spark.createDataFrame([(2, "d")], "id long, text string"), at)
    monkeypatch.undo()
    assert rows(B.read(spark, at)) == [(1, "c"), (2, "b")]
    with pytest.raises(ValueError):
        B.read(spark, str(tmp_path / "none"))
