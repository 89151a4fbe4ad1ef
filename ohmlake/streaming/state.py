"""Streams with state: job states, redrive with dead letters, and repeats dropped by watermark (STR-1, STR-5, STR-8, STR-10).

State is typed and lies in the RocksDB store. A job has a value, a map and a timer (transformWithState); a message in a queue has a count; ``session`` gives a session with that store, as no operator changes
a setting of the caller's. Every sink is written by (query, epoch), so a micro-batch that runs again replaces what it wrote.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from .jobs import MAX_RECEIVES, STATUSES, deduplicated, link_results

#: Fixed value: how long a message that failed is kept, 14 days.
RETENTION_MS = 14 * 24 * 3600 * 1000

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, in as many partitions as the caller's shuffles."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with times to live, runs of availableNow would not end
    return own


def files(spark: SparkSession, folder: str, schema: str | StructType, per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder and those below it, oldest first, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(folder)


def identity(checkpoint: str) -> str:
    """What a query keeps through its restarts: its checkpoint."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def into(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, str], None], mode: str = "append", **trigger):
    """Start a query that hands every micro-batch and the name of its own folder, ``query=.../epoch=...``, to put."""
    name = identity(checkpoint)
    out = stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: put(df, f"query={name}/epoch={epoch}"))
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def written(df: DataFrame, sink: str, at: str) -> None:
    """One micro-batch of a sink; written again, it replaces itself."""
    df.write.mode("overwrite").parquet(f"{sink}/{at}")


def read(spark: SparkSession, sink: str, schema: str | StructType) -> DataFrame:
    """All micro-batches of a sink, with ``epoch``."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*kind.fields, *StructType.fromDDL("query string, epoch long").fields])).parquet(sink).drop("query")


# ---------------------------------------------------------------- STR-1


def links_stream(texts: DataFrame, sink: str, checkpoint: str, **trigger):
    """STR-1 on a stream of (schematic_id, json): results of each micro-batch into a sink. Start; the caller waits."""
    return into(texts, checkpoint, lambda df, at: written(link_results(df), sink, at), **trigger)


# ---------------------------------------------------------------- STR-5


#: The time of events without one, before all others.
_NEVER = -(1 << 62)


class JobStates(StatefulProcessor):
    """STR-5: the state of one job: a value for its life, and a map from each field to its value and the event that gave it.

    Events count in the order (time, place of the status in a job's life, status), however they arrive. Jobs are many and have few events
    each, so events come and states go as rows, not as a table for each job; times are microseconds, whatever the time zone.
    """

    def __init__(self, fields: dict[str, str], idle_ms: int | None):
        self.fields, self.idle_ms = fields, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "created long, at long, rank int, status string, timer long")
        self.given = handle.getMapState("given", "field string", "whole long, text string, at long, rank int, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        life = self.life.get()
        created, last, timer = (life[0], tuple(life[1:4]), life[4]) if life else (None, None, 0)
        held = {k[0]: tuple(v) for k, v in self.given.iterator()} if life else {}
        known = dict(held)
        for row in rows:
            us, status = row["event_us"], row["status"]
            order = (_NEVER if us is None else us, STATUSES.index(status) + 1 if status in STATUSES else 0, status or "")
            if us is not None:
                created = us if created is None else min(created, us)
            last = order if last is None else max(last, order)
            for name, kind in self.fields.items():
                value = row[name]
                if value is not None and (name not in known or order > known[name][2:]):
                    known[name] = (int(value), None, *order) if kind != "string" else (None, value, *order)
        if self.idle_ms:
            due = last[0] // 1000 + self.idle_ms
            if due != timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        self.life.update((created, *last, timer))
        for name, value in known.items():
            if value is not held.get(name):
                self.given.updateValue((name,), value)
        typed = {n: known[n][1 if k == "string" else 0] if n in known else None for n, k in self.fields.items()}
        yield Row(processing_id=key[0], status=last[2], created_us=created, updated_us=None if last[0] == _NEVER else last[0], **typed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.life.clear()
        self.given.clear()
        return iter([])

    def close(self) -> None:
        pass


def job_states_held(events: DataFrame, fields: dict[str, str], idle_seconds: int | None = None) -> DataFrame:
    """STR-5 on a stream of a ``session``: a row for each job that changed, in update mode; the last equals ``job_states``.

    fields: names and types, whole numbers (bigint) or string. With ``idle_seconds`` a timer forgets a job when the watermark, late by as
    much, has passed its last event by that time; else state grows with the jobs.
    """
    own = events.select("processing_id", "event_ts", F.unix_micros("event_ts").alias("event_us"), "status", *fields)
    if idle_seconds:
        own = own.withWatermark("event_ts", f"{idle_seconds} seconds")
    out = "processing_id string, status string, created_us long, updated_us long, " + ", ".join(f"{n} {k}" for n, k in fields.items())
    made = JobStates(dict(fields), 1000 * idle_seconds if idle_seconds else None)
    states = own.groupBy("processing_id").transformWithState(made, StructType.fromDDL(out), "Update", "EventTime" if idle_seconds else "None")
    at = lambda c: F.timestamp_micros(f"{c}_us").alias(f"{c}_at")
    return states.select("processing_id", "status", at("created"), at("updated"), *fields)


# ---------------------------------------------------------------- STR-8


QUEUE = "key string, body string, receives int"
OUTCOMES = "key string, body string, receives int, outcome string, error string"
#: Buckets that a queue's keys lie in, unless given, and messages to a file that goes back into the queue.
BUCKETS = 4096
FILE_ROWS = 1_000_000


def outcomes(received: DataFrame, most: int = MAX_RECEIVES, retention_ms: int = RETENTION_MS, buckets: int = BUCKETS) -> DataFrame:
    """STR-8 on a stream of a ``session``: each receive (key, body, ok, error) with its number and outcome: done, again, or dead at the ``most``-th failure.

    State is the number of failures of each key since its message last worked or was given up, with the time of the last one; a key
    that rests for the retention time is dropped. Messages are many and short-lived, so keys lie in buckets, of which a micro-batch
    makes one call each; a bucket holds only keys that failed. A checkpoint keeps its number of buckets. A null ok has failed.
    """

    def step(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {k: (n, at) for k, n, at in zip(*state.get) if now - at < retention_ms} if state.exists else {}
        if not state.hasTimedOut:
            for pdf in batches:
                receives, outcome = [], []
                for key, ok in zip(pdf["key"], pdf["ok"]):
                    n = held.pop(key, (0, 0))[0] + 1
                    receives.append(n)
                    outcome.append("done" if ok else "dead" if n >= most else "again")
                    if outcome[-1] == "again":
                        held[key] = (n, now)
                yield pd.DataFrame({"key": pdf["key"], "body": pdf["body"], "receives": receives, "outcome": outcome, "error": pdf["error"].where(~pdf["ok"], None)})
        if held:
            state.update((list(held), [n for n, _ in held.values()], [at for _, at in held.values()]))
            state.setTimeoutDuration(max(1, min(at for _, at in held.values()) + retention_ms - now))
        elif state.exists:
            state.remove()

    own = received.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "body", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("error").cast("string").alias("error"))
    return own.groupBy("bucket").applyInPandasWithState(step, OUTCOMES, "keys array<string>, failures array<int>, at array<long>", "append", "ProcessingTimeTimeout")


def redriven(spark: SparkSession, queue: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, most: int = MAX_RECEIVES, per_batch: int = 1) -> int:
    """STR-8: work off a queue, a folder of Parquet files of QUEUE rows, until no message is left in it; the number of runs.

    work adds ok and error to messages, of which receives are those before (null: none). One that fails goes back into the queue
    until its ``most``-th failure and then to the dead letters. sink/outcomes has every receive, sink/dead the messages given up.
    What goes back is written below the queue by (query, epoch) for the next run, FILE_ROWS messages to a file, so that runs are as many as receives.
    """
    own, runs = session(spark), 0
    while True:
        back: list[str] = []

        def put(df: DataFrame, at: str) -> None:
            written(df, f"{sink}/outcomes", at)  # the one action on the stateful plan
            kept = df.sparkSession.read.schema(OUTCOMES).parquet(f"{sink}/outcomes/{at}")
            found = {r[0]: r[1] for r in kept.groupBy("outcome").count().collect()}  # three at most
            if "dead" in found:
                written(kept.where("outcome = 'dead'").select("key", "body", "receives", "error"), f"{sink}/dead", at)
            if "again" in found:
                parts = -(-found["again"] // FILE_ROWS)  # micro-batches go by files
                written(kept.where("outcome = 'again'").select("key", "body", "receives").coalesce(parts), f"{queue}/again", at)
                back.append(at)

        query = into(outcomes(work(files(own, queue, QUEUE, per_batch)), most), checkpoint, put)
        query.awaitTermination()
        runs += 1
        if not back:
            return runs


# ---------------------------------------------------------------- STR-10


def deduplicated_into(messages: DataFrame, sink: str, checkpoint: str, ts: str = "event_ts", delay: str = "10 minutes", **trigger):
    """STR-10: first messages of a stream into a sink. Repeats within the delay are dropped, and so are messages that are late by more.

    Spark drops late messages by the watermark of the micro-batch before the last.
    """
    return into(deduplicated(messages, ts, delay), checkpoint, lambda df, at: written(df, sink, at), **trigger)
