"""Plans and tasks that must not grow with the tables: no broadcast of what grows, bounded pieces."""

import json
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from ohmlake.operators import nets as N
from ohmlake.plans.components import connected_components
from ohmlake.plans.forest import spanning_forest
from ohmlake.plans.grid import near
from ohmlake.queries import QUERIES
from ohmlake.sources import designs as S

AT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nets_broadcast_nothing(spark):
    for name in ("net1_touching_wires", "net2_wire_groups", "net3_net_numbers", "net4_labels_on_nets", "net5_junctions_on_nets", "net6_pins_on_nets", "net7_assembled_nets"):
        assert "Broadcast" not in plan(QUERIES[name](spark, AT)), name


def test_steps_of_components_and_forests_broadcast_nothing(spark, monkeypatch):
    from ohmlake.plans import components, forest, storage

    seen = []

    def stored(df, name):
        seen.append(plan(df))
        return storage.stored(df, name)

    monkeypatch.setattr(components, "stored", stored)
    monkeypatch.setattr(forest, "stored", stored)
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(50)], "s long, a long, b long")
    assert connected_components(edges).count() == 51 and spanning_forest(edges, ["s"]).count() == 50
    assert len(seen) > 6 and not any("Broadcast" in p for p in seen)


def test_points_of_a_coarse_grid_take_about_a_cell_each(spark):
    rng = random.Random(7)
    pts = [(i, rng.randint(0, 9) + rng.choice([0.0, 0.004, 0.0099, 0.02]), float(rng.randint(0, 9))) for i in range(300)] + [(300, math.nan, 1.0), (301, math.inf, 1.0), (302, None, 1.0)]
    a = spark.createDataFrame([(0, *p) for p in pts], "s long, a long, ax double, ay double")
    b = a.toDF("s", "b", "bx", "by")
    want = {(p[0], q[0]) for p in pts[:300] for q in pts[:300] if math.hypot(p[1] - q[1], p[2] - q[2]) <= N.TOLERANCE}
    for width in (1.0, N.CELL, 1000.0):
        joined = near(a, b, N.TOLERANCE, ["s"], "ax", "ay", "bx", "by", width)
        got = [(r.a, r.b) for r in joined.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_texts_of_files_are_not_broadcast(spark):
    assert "BroadcastHashJoin [schematic_id" not in plan(QUERIES["sch13_statistics"](spark, AT))


def test_items_of_many_files_come_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 2000)
    one = "(kicad_sch " + " ".join(f'(text "t{i}" (at {i} 2 0))' for i in range(40)) + ")"
    texts = [one, "(other)", None, "(kicad_sch", one] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["schematic_id", "content"])
    pieces = list(S._pieces(iter([batch, batch]), S.schematic_items))
    assert len(pieces) > 50 and max(sum(map(len, p["payload"].to_pylist())) for p in pieces) < 2200
    rows = [tuple(r.values()) for p in pieces for r in p.to_pylist()]
    want = [(n, "text", i, json.dumps(f)) for n, t in enumerate(texts) if t == one for i, (_, f) in enumerate(S.schematic_items(one))]
    assert [r for r in rows if r[1] == "text"] == want * 2
    assert sum(r[1] == "reject" for r in rows) == 120


def test_redrive_calls_by_bucket_and_sends_back_few_files(spark, tmp_path):
    from ohmlake.streaming import state as T

    queue, sink, own = str(tmp_path / "q"), str(tmp_path / "out"), T.session(spark)
    spark.range(400).selectExpr("concat('m', id) key", "'x' body", "cast(null as int) receives").repartition(4).write.parquet(queue)
    work = lambda df: df.selectExpr("*", "receives = 1 ok", "'e' error")  # noqa: E731  null: fails at first
    assert T.redriven(spark, queue, work, sink, str(tmp_path / "c"), per_batch=4) == 2
    rows = T.read(spark, f"{sink}/outcomes", T.OUTCOMES).collect()
    assert sorted((r.key, r.receives, r.outcome) for r in rows) == sorted((f"m{i}", n, o) for i in range(400) for n, o in ((1, "again"), (2, "done")))
    assert len(list((tmp_path / "q" / "again").rglob("*.parquet"))) == 1
    made = []
    stream = T.outcomes(work(T.files(own, queue, T.QUEUE, 9)), buckets=4)
    T.into(stream, str(tmp_path / "c2"), lambda df, at: made.append(df.count())).awaitTermination(200)
    keys = spark.read.format("statestore").load(str(tmp_path / "c2")).count()
    assert sum(made) == 800 and keys <= 4  # a state for a bucket, not for a key


def test_cleaned_texts_are_made_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 100)
    sizes, array = [], pa.array
    texts = array(["x" * 30, None, "bad", ""] * 50)

    def counted(values, kind):
        sizes.append(sum(len(v or "") for v in values))
        return array(values, kind)

    monkeypatch.setattr(S.pa, "array", counted)
    made = S._in_pieces(texts, lambda t: str(int(t)) if t == "bad" else t + "y")
    assert made.to_pylist() == ["x" * 30 + "y", None, None, "y"] * 50
    assert len(sizes) > 10 and max(sizes) < 140


def test_texts_of_few_rows_are_dealt_over_all_tasks(spark):
    """A file of parts is one split, but its texts are not one task's work."""
    for name in ("rsp3_technical", "rsp8_pins", "rsp10_all_connections", "rsp11_precautions", "rsp12_development", "rsp18_power_facts", "rsp22_summaries", "dtx4_parenthetical_pins", "dtx14_specifications"):
        assert "hashpartitioning(p_partkey" in plan(QUERIES[name](spark, AT)), name
    for name in ("rsp3_technical", "dtx4_parenthetical_pins"):
        rows = QUERIES[name](spark, AT).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) >= 4, name


def test_link_results_parse_each_text_once(spark):
    from ohmlake.streaming.jobs import link_results

    made = '{"components":{"R1":{"reference":"R1","value":"1k","properties":{"Datasheet":{"value":"https://a.b/c.pdf"}}}}}'
    texts = spark.createDataFrame([(1, made), (2, "{"), (3, None)], "schematic_id long, json string")
    got = link_results(texts)
    assert "_json" not in plan(got)  # the texts are parsed where the documents are stored, not in each branch
    assert {(r.schematic_id, r.datasheet_count) for r in got.collect()} == {(1, 1), (2, 0), (3, 0)}


def test_streamed_documents_lie_in_files_for_many_tasks(spark, monkeypatch):
    from ohmlake.queries import streams

    seen = []
    files = streams.T.files
    monkeypatch.setattr(streams.T, "files", lambda s, folder, schema, per_batch=1: seen.append((len(s.read.schema(schema).parquet(folder).inputFiles()), per_batch)) or files(s, folder, schema, per_batch))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert QUERIES["str1_streamed_results"](spark, AT).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0][0] > 3 and -(-seen[0][0] // seen[0][1]) <= 3
