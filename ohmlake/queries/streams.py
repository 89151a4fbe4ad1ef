"""Queries that run as streams with availableNow, over files of the given tables, and read their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ohmlake.plans.storage import fresh_folder
from ohmlake.streaming import state as T

from .base import given, spread
from .texts import document_json, status_events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def arrivals(df: DataFrame, folder: str, part: str, parts: range) -> None:
    """Files that arrive one after the other: the rows of each part, which are as many as a test of batches needs, not as the data."""
    for i in parts:
        df.where(F.col(part) == i).drop(part).coalesce(1).write.mode("append").parquet(folder)


@query("str1_streamed_results", "SELECT schematic_id, count(DISTINCT datasheet)::BIGINT AS datasheet_count FROM (SELECT schematic_id, CASE WHEN datasheet LIKE 'https://%' THEN datasheet END AS datasheet FROM comps) GROUP BY ALL")
def _(spark, d):
    top = fresh_folder(spark, "links")
    docs = document_json(spark, d).select("schematic_id", "json")
    spread(docs, F.xxhash64("schematic_id")).write.parquet(f"{top}/in")
    files = len(spark.read.schema(docs.schema).parquet(f"{top}/in").inputFiles())
    per_batch = max(1, -(-files // 3))  # about three micro-batches, each of files for many tasks
    T.links_stream(T.files(spark, f"{top}/in", docs.schema, per_batch), f"{top}/out", f"{top}/state").awaitTermination()
    return T.read(spark, f"{top}/out", "schematic_id long, datasheet_count long").select("schematic_id", "datasheet_count")


@query("str5_streamed_states", """
WITH e AS (SELECT user_id::VARCHAR AS processing_id, ts, CASE event_type WHEN 'click' THEN 'uploaded' WHEN 'view' THEN 'stage1_processing' WHEN 'signup' THEN 'stage1_complete' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'signup' THEN (props->>'k')::BIGINT END AS cc, CASE WHEN event_type = 'error' THEN props END AS err FROM events)
SELECT processing_id, arg_max(status, ts) AS status, arg_max(cc, ts) FILTER (cc IS NOT NULL) AS component_count, arg_max(err, ts) FILTER (err IS NOT NULL) AS error_message,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM e GROUP BY ALL""")
def _(spark, d):
    """Events in four parts of any order; the stream is stopped after two and started again from its checkpoint."""
    top, own = fresh_folder(spark, "jobs"), T.session(spark)
    fields = {"component_count": "bigint", "error_message": "string"}
    events = status_events(spark, d).select("processing_id", "event_ts", "status", *fields)
    parts = events.withColumn("part", F.pmod(F.xxhash64("processing_id", "event_ts"), F.lit(4)))
    for half in (range(2), range(2, 4)):
        parts.where(F.col("part").isin(*half)).drop("part").write.mode("append").parquet(f"{top}/in")  # by as many tasks as read them
        files = len(spark.read.schema(events.schema).parquet(f"{top}/in").inputFiles())
        states = T.job_states_held(T.files(own, f"{top}/in", events.schema, files), fields)
        T.into(states, f"{top}/state", lambda df, at: T.written(df, f"{top}/out", at), "update").awaitTermination()
    changed = T.read(spark, f"{top}/out", "processing_id string, status string, created_at timestamp, updated_at timestamp, component_count bigint, error_message string")
    last = changed.groupBy("processing_id").agg(F.max_by(F.struct(*[c for c in changed.columns if c != "processing_id"]), "epoch").alias("s"))
    shown = lambda c: F.date_format(f"s.{c}", "yyyy-MM-dd HH:mm:ss")
    return last.select("processing_id", "s.status", "s.component_count", "s.error_message", shown("created_at").alias("created"), shown("updated_at").alias("updated"))


@query("str8_redriven", "SELECT event_id::VARCHAR AS key, CASE WHEN value > 40 THEN 1 WHEN value > 25 THEN 2 ELSE 3 END::INTEGER AS receives, CASE WHEN value > 10 THEN 'done' ELSE 'dead' END AS outcome FROM events")
def _(spark, d):
    """Every event is a message whose value is how well it does; each receive makes it better by 15."""
    top = fresh_folder(spark, "queue")
    queue = given(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("value").cast("string").alias("body"), F.lit(None).cast("int").alias("receives"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    arrivals(queue, f"{top}/in", "part", range(3))

    def work(df: DataFrame) -> DataFrame:
        return df.withColumns({"ok": F.col("body").cast("double") > 40 - 15 * F.coalesce("receives", F.lit(0)), "error": F.lit("not yet")})

    T.redriven(spark, f"{top}/in", work, f"{top}/out", f"{top}/state", per_batch=2)
    done = T.read(spark, f"{top}/out/outcomes", T.OUTCOMES).where("outcome = 'done'").select("key", "receives", "outcome")
    dead = T.read(spark, f"{top}/out/dead", "key string, body string, receives int, error string").select("key", "receives", F.lit("dead").alias("outcome"))
    return done.unionByName(dead)


@query("str10_streamed_firsts", "SELECT event_id::VARCHAR AS processing_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first FROM events")
def _(spark, d):
    """Four stretches of days, one after the other. Repeats come a minute later in the same stretch and again in the next;
    the last stretch brings messages of the first one's days, too late for a delay of a day, under ids of their own."""
    top = fresh_folder(spark, "messages")
    own = given(spark, d, "events").select(F.col("event_id").cast("string").alias("processing_id"), F.col("ts").cast("timestamp").alias("event_ts"), F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)).alias("part"))
    soon = own.withColumn("event_ts", F.col("event_ts") + F.expr("interval 1 minute"))
    following = own.where("part < 3").withColumn("part", F.col("part") + 1)
    late = own.where("part = 0").select(F.concat(F.lit("late-"), "processing_id").alias("processing_id"), "event_ts", F.lit(3).cast("long").alias("part"))
    arrivals(own.unionByName(soon).unionByName(following).unionByName(late), f"{top}/in", "part", range(4))
    stream = T.files(T.session(spark), f"{top}/in", "processing_id string, event_ts timestamp")
    T.deduplicated_into(stream, f"{top}/out", f"{top}/state", delay="1 day").awaitTermination()
    kept = T.read(spark, f"{top}/out", "processing_id string, event_ts timestamp")
    # of a message and its repeat in one micro-batch either may be the first
    first = F.when(F.row_number().over(Window.partitionBy("processing_id").orderBy("event_ts")) == 1, F.col("event_ts"))
    sent = own.select("processing_id", F.col("event_ts").alias("sent"))
    found = kept.withColumn("first", first).join(sent, "processing_id", "left")
    at = F.when(F.col("first").between(F.col("sent"), F.col("sent") + F.expr("interval 1 minute")), F.col("sent")).otherwise(F.col("first"))
    return found.select("processing_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("first"))
