"""Streams with typed state against what batches give, through restarts and batches that run twice."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ohmlake.streaming import jobs as J, state as T

FIELDS = {"component_count": "bigint", "net_count": "bigint", "error_message": "string"}
EVENTS = "processing_id string, event_ts timestamp, status string, component_count long, net_count long, error_message string"


def made(rng, n):
    day = datetime(2024, 1, 1)
    maybe = lambda v: v if rng.random() < 0.4 else None
    return [(f"j{rng.randrange(12)}", day + timedelta(seconds=rng.randrange(40)), rng.choice([*J.STATUSES, "odd"]), maybe(rng.randrange(9)), maybe(rng.randrange(9)), maybe(rng.choice("xyz"))) for _ in range(n)]


def put(spark, rows, folder, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_job_states_through_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows, folder, sink, c = made(rng, 120), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    own = T.session(spark)
    for half in (rows[:50], rows[50:]):  # the second run takes up the first one's state
        for at in range(0, len(half), 25):
            put(spark, half[at : at + 25], folder)
        T.into(T.job_states_held(T.files(own, folder, EVENTS), FIELDS), c, lambda df, at: T.written(df, sink, at), "update").awaitTermination(200)
    kinds = "processing_id string, status string, created_at timestamp, updated_at timestamp, component_count long, net_count long, error_message string"
    got = {r.processing_id: r for r in T.read(spark, sink, kinds).orderBy("epoch").collect()}
    want = {r.processing_id: r for r in J.job_states(spark.createDataFrame(rows, EVENTS), list(FIELDS)).collect()}
    assert set(got) == set(want)
    # values of equal order may come from either event
    order = lambda r: (r[1], J.STATUSES.index(r[2]) + 1 if r[2] in J.STATUSES else 0, r[2])
    for k, r in want.items():
        g = got[k]
        assert (g.status, g.created_at, g.updated_at) == (r.status, r.created_at, r.updated_at)
        for i, f in enumerate(FIELDS):
            given = [x for x in rows if x[0] == k and x[3 + i] is not None]
            may = {x[3 + i] for x in given if order(x) == max(map(order, given))} or {None}
            assert g[f] in may


def test_timers_forget_idle_jobs(spark, tmp_path):
    hour = lambda h: datetime(2024, 1, 1, h)
    own, folder, seen = T.session(spark), str(tmp_path / "in"), []
    for day in ([("a", 1), ("b", 1)], [("c", 6)], [("c", 9)], [("b", 9), ("c", 10)]):
        put(spark, [(k, hour(h), "uploaded", h, None, None) for k, h in day], folder)
        q = T.into(T.job_states_held(T.files(own, folder, EVENTS), FIELDS, 3600), str(tmp_path / "c"), lambda df, _: seen.extend(df.collect()), "update")
        q.awaitTermination(200)
    last = {r.processing_id: r for r in seen}
    assert (last["b"].created_at, last["c"].created_at, last["c"].component_count) == (hour(9), hour(6), 10)


def work(df):
    """Message n works at its n-th receive."""
    now = F.coalesce("receives", F.lit(0)) + 1
    return df.withColumns({"ok": now >= F.col("body").cast("int"), "error": F.concat(F.lit("try "), now.cast("string"))})


def test_redrive(spark, tmp_path):
    queue, sink = str(tmp_path / "q"), str(tmp_path / "out")
    rows = [(f"m{i}", str(1 + i % 5), None) for i in range(20)]
    put(spark, rows[:9], queue, T.QUEUE)
    put(spark, [*rows[9:], ("m0", None, None)], queue, T.QUEUE)  # a key twice; a null body never works
    assert T.redriven(spark, queue, work, sink, str(tmp_path / "c")) == 3
    dead = {(r.key, r.body, r.receives, r.error) for r in T.read(spark, f"{sink}/dead", "key string, body string, receives int, error string").collect()}
    assert dead == {(f"m{i}", str(1 + i % 5), 3, "try 3") for i in range(20) if i % 5 > 2} | {("m0", None, 3, "try 3")}
    every = T.read(spark, f"{sink}/outcomes", T.OUTCOMES).collect()
    assert sorted((r.key, r.receives) for r in every if r.outcome == "done") == sorted((f"m{i}", 1 + i % 5) for i in range(20) if i % 5 < 3)
    # nothing new: a further run changes nothing
    assert T.redriven(spark, queue, work, sink, str(tmp_path / "c")) == 1
    assert len(T.read(spark, f"{sink}/outcomes", T.OUTCOMES).collect()) == len(every)


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    queue, sink, c = str(tmp_path / "q"), str(tmp_path / "out"), str(tmp_path / "c")
    put(spark, [(f"m{i}", "2", None) for i in range(6)], queue, T.QUEUE)
    own, failed = T.session(spark), []

    def broken(df, at):
        T.written(df, f"{sink}/outcomes", at)
        if not failed:
            failed.append(at)
            raise ValueError("lost after writing")

    start = lambda: T.into(T.outcomes(work(T.files(own, queue, T.QUEUE))), c, broken)
    with pytest.raises(Exception):
        start().awaitTermination(200)
    start().awaitTermination(200)
    rows = T.read(spark, f"{sink}/outcomes", T.OUTCOMES).collect()
    assert failed and sorted((r.key, r.receives, r.outcome) for r in rows) == [(f"m{i}", 1, "again") for i in range(6)]


def test_repeats_and_late_messages(spark, tmp_path):
    folder, sink, own = str(tmp_path / "in"), str(tmp_path / "out"), T.session(spark)
    minute = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    for rows in ([("a", 0), ("a", 1), ("b", 2)], [("a", 8), ("c", 20)], [("e", 21)], [("d", 3), ("f", 22), ("c", 22)]):  # d is late by more than ten minutes
        put(spark, [(k, minute(m), "uploaded", None, None, None) for k, m in rows], folder)
    T.deduplicated_into(T.files(own, folder, EVENTS), sink, str(tmp_path / "c")).awaitTermination(200)
    assert sorted(r.processing_id for r in T.read(spark, sink, EVENTS).collect()) == ["a", "b", "c", "e", "f"]


def test_links_by_epoch(spark, tmp_path):
    docs = [("x", '{"components":{"R1":{"value":"v","properties":{"Datasheet":{"value":"https://a.b/c.pdf"}}}}}'), ("y", "not json"), ("z", "{}")]
    for d in docs:
        put(spark, [d], str(tmp_path / "in"), "schematic_id string, json string")
    stream = T.files(spark, str(tmp_path / "in"), "schematic_id string, json string")
    T.links_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(200)
    got = T.read(spark, str(tmp_path / "out"), "schematic_id string, datasheet_count long, success boolean").collect()
    assert {r.schematic_id: (r.datasheet_count, r.success) for r in got} == {"x": (1, True), "y": (0, False), "z": (0, True)}
    assert {r.epoch for r in got} == {0, 1, 2}
