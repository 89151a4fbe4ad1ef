"""The event-driven pipeline (STR-1 to STR-10): functions of a DataFrame that serve batches and streams alike.

Only ``job_states_stream`` and ``deduplicated`` keep state; both are keyed by processing_id.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.operators.circuit import link_messages, unique_links
from ohmlake.plans.storage import stored
from ohmlake.sources.files import LINKED, document_components, document_symbols, not_json

MAX_UPLOAD = 10 * 1024 * 1024
MAX_RECEIVES = 3
STAGE = "stage1"

# Statuses in the order of a job's life; the last of equal times is the later one.
STATUSES = ["uploaded", "stage1_processing", "stage1_complete", "stage1_failed", "stage2_processing", "completed", "failed"]
OPTIONAL = ["original_filename", "s3_key", "file_size", "content_type", "stage1_output_key", "component_count", "net_count", "error_message"]

MESSAGE = "processing_id string, stage string, s3_key string, original_filename string, attempts int"


def link_results(texts: DataFrame) -> DataFrame:
    """STR-1: a result row for each JSON text (schematic_id, json); one that fails gives a row that says so.

    Links are grouped within a micro-batch, so on a stream this runs in foreachBatch (``each_batch``). Each text is parsed
    once: its symbols, components and title come from the stored document.
    """
    parsed = texts.select("schematic_id", F.from_json("json", LINKED).alias("d"), not_json("json").alias("error"))
    docs = stored(parsed, "documents").select("schematic_id", "error", "d.*")
    good = docs.where("error is null")
    links = unique_links(document_symbols(good), document_components(good))
    return link_messages(docs.select("schematic_id", "error", F.col("metadata.title_block").alias("title_block")), links)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger):
    """Run a batch operator on every micro-batch and append its rows to a Parquet folder; a batch that runs again overwrites itself."""

    def run(df: DataFrame, epoch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def unwrapped(messages: DataFrame, value: str = "value") -> DataFrame:
    """STR-2: messages with ``m``, the fields of the body, which may stand in an envelope's Message."""
    inner = F.coalesce(F.from_json(value, "Message string")["Message"], F.col(value).cast("string"))
    return messages.withColumn("m", F.from_json(inner, MESSAGE))


def of_stage(messages: DataFrame, stage: str = STAGE) -> DataFrame:
    """STR-3."""
    return messages.where(F.col("m.stage") == stage)


def intake(uploads: DataFrame) -> DataFrame:
    """STR-4: uploads (processing_id, filename, file_size, ts) as initial jobs, or rejects over MAX_UPLOAD (``error``)."""
    low = F.lower("filename")
    return uploads.select(
        "processing_id", F.col("filename").alias("original_filename"), F.concat(F.lit("raw/"), "processing_id", F.lit("/"), "filename").alias("s3_key"), "file_size",
        F.when(low.endswith(".kicad_sch"), "kicad-schematic").otherwise("unknown").alias("content_type"), F.lit("uploaded").alias("status"), F.col("ts").alias("event_ts"),
        F.when(F.col("file_size") > MAX_UPLOAD, "File too large").alias("error"),
    )


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def job_states(events: DataFrame, fields: list[str] = OPTIONAL) -> DataFrame:
    """STR-5 on a batch: the state of each job: last status and time, and the last value of each field that was given.

    Order: event time, then the status's place in a job's life, whatever order the events come in.
    """
    order = F.struct("event_ts", status_rank(F.col("status")).alias("r"), "status")
    kept = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return events.groupBy("processing_id").agg(F.max_by("status", order).alias("status"), F.min("event_ts").alias("created_at"), F.max("event_ts").alias("updated_at"), *kept)


def job_states_stream(events: DataFrame, fields: dict[str, str] | None = None, idle_seconds: int | None = None) -> DataFrame:
    """STR-5 on a stream: a row for each job that changed, in update mode; equal to ``job_states`` when all is in.

    State: for the status and each field its value with the order of the event that gave it. With ``idle_seconds`` a
    job is forgotten when the watermark, late by as much, is that long past its last event; without, state
    grows with the number of jobs.
    """
    fields = fields or {"component_count": "bigint", "net_count": "bigint", "error_message": "string"}
    names = list(fields)
    out = "processing_id string, status string, created_at timestamp, updated_at timestamp, " + ", ".join(f"{n} {k}" for n, k in fields.items())
    state_ddl = "data string"

    def step(key, batches, state):
        import json

        if state.hasTimedOut:
            state.remove()
            return
        last = state.getCurrentWatermarkMs() if idle_seconds else 0
        held = json.loads(state.get[0]) if state.exists else {"created": None, "status": None, "fields": {}}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ts = pd.Timestamp(row.event_ts).value
                last = max(last, row.event_ms)
                order = [ts, STATUSES.index(row.status) + 1 if row.status in STATUSES else 0, row.status or ""]
                held["created"] = ts if held["created"] is None else min(held["created"], ts)
                if held["status"] is None or order > held["status"]:
                    held["status"] = order
                for n in names:
                    value = getattr(row, n)
                    if value is None or value != value:
                        continue
                    value = value.item() if hasattr(value, "item") else value
                    if n not in held["fields"] or order > held["fields"][n][1]:
                        held["fields"][n] = [value, order]
        state.update((json.dumps(held),))
        if idle_seconds:
            state.setTimeoutTimestamp(int(last) + 1000 * idle_seconds)
        yield pd.DataFrame({"processing_id": [key[0]], "status": [held["status"][2]], "created_at": [pd.Timestamp(held["created"])], "updated_at": [pd.Timestamp(held["status"][0])]} | {n: pd.Series([held["fields"].get(n, [None])[0]], dtype="Int64" if fields[n] in ("int", "bigint") else object) for n in names})

    own = events.select("processing_id", "event_ts", F.unix_millis("event_ts").alias("event_ms"), "status", *names)
    if idle_seconds:
        own = own.withWatermark("event_ts", f"{idle_seconds} seconds")
    return own.groupBy("processing_id").applyInPandasWithState(step, out, state_ddl, "update", "EventTimeTimeout" if idle_seconds else "NoTimeout")


def stage_results(parsed: DataFrame) -> DataFrame:
    """STR-6: a status event for each parsed document (processing_id, component_count, net_count, error, event_ts)."""
    failed = F.col("error").isNotNull()
    none = F.lit(None)
    return parsed.select(
        "processing_id", "event_ts", F.when(failed, "stage1_failed").otherwise("stage1_complete").alias("status"),
        F.when(~failed, F.concat(F.lit("stage1/"), "processing_id", F.lit(".json"))).alias("stage1_output_key"),
        F.when(~failed, F.col("component_count")).otherwise(none).alias("component_count"), F.when(~failed, F.col("net_count")).otherwise(none).alias("net_count"),
        F.when(failed, F.col("error")).alias("error_message"),
    )


def next_stage(results: DataFrame, stage: str = "stage2") -> DataFrame:
    """STR-7: (key, value) messages for the next stage, for results that are complete."""
    body = F.struct("processing_id", F.lit(stage).alias("stage"), F.col("stage1_output_key").alias("s3_key"), "component_count", "net_count")
    return results.where(F.col("status") == "stage1_complete").select(F.col("processing_id").alias("key"), F.to_json(body).alias("value"))


def dead_letters(attempts: DataFrame, most: int = MAX_RECEIVES) -> DataFrame:
    """STR-8: records (key, ok, ...) that failed ``most`` times and never worked: (key, receives, last_error).

    attempts: (key, event_ts, ok, error), one row a receive.
    """
    own = attempts.groupBy("key").agg(F.count_if(~F.col("ok")).alias("receives"), F.bool_or("ok").alias("worked"), F.max_by("error", "event_ts").alias("last_error"))
    return own.where(~F.col("worked") & (F.col("receives") >= most)).drop("worked")


def job_status(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """STR-9: requests with the state of their job, and found."""
    return requests.join(jobs.withColumn("found", F.lit(True)), "processing_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def deduplicated(messages: DataFrame, ts: str = "event_ts", delay: str = "10 minutes") -> DataFrame:
    """STR-10: one message for each processing_id; on a stream, repeats within the watermark's delay."""
    if messages.isStreaming:
        return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["processing_id"])
    rank = F.row_number().over(Window.partitionBy("processing_id").orderBy(ts))
    return messages.withColumn("_r", rank).where("_r = 1").drop("_r")
