"""The streaming operators give what the batch ones give."""

from pyspark.sql import functions as F

from ohmlake.streaming import jobs as J

EVENTS = "processing_id string, event_ts timestamp, status string, component_count long, net_count long, error_message string"


def rows(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    data = [("a", t(5), "stage1_complete", 7, 3, None), ("a", t(1), "uploaded", None, None, None), ("a", t(5), "stage1_processing", 1, None, None), ("b", t(2), "uploaded", None, None, None), ("b", t(9), "stage1_failed", None, None, "bad"), ("b", t(2), "uploaded", None, None, None), ("c", t(3), "odd", None, None, None)]
    return spark.createDataFrame(data, "processing_id string, event_ts string, status string, component_count long, net_count long, error_message string").withColumn("event_ts", F.col("event_ts").cast("timestamp")).select("processing_id", "event_ts", "status", "component_count", "net_count", "error_message")


def stream(spark, tmp_path, df, schema):
    for i, part in enumerate(df.randomSplit([0.5, 0.5], seed=3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_job_states(spark, tmp_path):
    fields = ["component_count", "net_count", "error_message"]
    want = {r.processing_id: r for r in J.job_states(rows(spark), fields).collect()}
    assert (want["a"].status, want["a"].component_count, want["b"].status, want["b"].error_message) == ("stage1_complete", 7, "stage1_failed", "bad")
    latest = {}

    def keep(df, _):
        for r in df.collect():
            latest[r.processing_id] = r

    q = J.job_states_stream(stream(spark, tmp_path, rows(spark), EVENTS)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert set(latest) == set(want)
    for k, r in want.items():
        assert (latest[k].status, latest[k].created_at, latest[k].component_count, latest[k].error_message) == (r.status, r.created_at, r.component_count, r.error_message)


def test_idle_jobs_are_forgotten(spark, tmp_path):
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    days = [[("a", t(1), "uploaded"), ("b", t(1), "uploaded")], [("c", t(6), "uploaded")], [("c", t(9), "uploaded")], [("b", t(9), "stage1_complete"), ("c", t(10), "stage1_complete")]]
    seen = []
    for day in days:
        df = spark.createDataFrame([(*x, None, None, None) for x in day], EVENTS.replace("timestamp", "string")).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        q = J.job_states_stream(events, idle_seconds=3600).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {r.processing_id: r for r in seen}
    assert last["b"].created_at.hour == 9 and last["c"].created_at.hour == 6 and last["c"].status == "stage1_complete"
    assert q.lastProgress is None or q.lastProgress.stateOperators[0].numRowsTotal == 2


def test_repeats_within_the_watermark(spark, tmp_path):
    q = J.deduplicated(stream(spark, tmp_path, rows(spark), EVENTS)).select("processing_id").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"] == sorted(r.processing_id for r in J.deduplicated(rows(spark)).collect())


def test_links_of_each_batch(spark, tmp_path):
    docs = spark.createDataFrame([("x", '{"components":{"R1":{"value":"v","properties":{"Datasheet":{"value":"https://a.b/c.pdf"}}}}}'), ("y", "not json"), ("z", "{}")], "schematic_id string, json string")
    want = {r.schematic_id: (r.datasheet_count, r.success) for r in J.link_results(docs).collect()}
    assert want == {"x": (1, True), "y": (0, False), "z": (0, True)}
    q = J.each_batch(stream(spark, tmp_path, docs, "schematic_id string, json string"), J.link_results, str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.schematic_id: (r.datasheet_count, r.success) for r in got} == want
