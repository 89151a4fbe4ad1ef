import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ohmlake.sources import files as S2
from ohmlake.sources.log import LogWriter, Written

NAMES = [f.split()[0] for f in S2.DOWNLOAD_LOG.split(", ")]


def rows(spark, n, note="x"):
    log = spark.range(n).repartition(3)
    return log.select(*[(F.col("id").cast("string") if c == "filename" else F.lit(note)).alias(c) for c in NAMES])


def texts(path):
    return [f.read_text() for f in path.rglob("*.csv") if "_staging" not in str(f)]


def test_batches_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    S2.append_download_log(rows(spark, 50), path, "a")
    S2.append_download_log(rows(spark, 50), path, "a")
    S2.append_download_log(rows(spark, 7, 'q "quoted",\nline'), path)
    S2.append_download_log(rows(spark, 7, None), path)
    S2.append_download_log(rows(spark, 7, ""), path)
    S2.append_download_log(rows(spark, 0), path, "none")
    got = S2.read_download_log(spark, path)
    assert got.count() == 71 and got.where(F.col("url") == 'q "quoted",\nline').count() == 7
    assert got.where("url is null").count() == 14  # of an empty field CSV does not say which it was
    assert len(texts(tmp_path)) > 4 and all(t.startswith('"timestamp","filename"') for t in texts(tmp_path))
    with pytest.raises(Exception, match="named in letters"):
        S2.append_download_log(rows(spark, 1), path, "../b")


def test_a_task_that_fails_appends_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    S2.append_download_log(rows(spark, 5), path, "a")
    bad = rows(spark, 40).withColumn("url", F.when(F.col("filename") == "33", F.raise_error(F.lit("lost"))).otherwise("u"))
    with pytest.raises(Exception, match="lost"):
        S2.append_download_log(bad, path, "b")
    assert S2.read_download_log(spark, path).count() == 5
    S2.append_download_log(rows(spark, 40), path, "b")
    assert S2.read_download_log(spark, path).count() == 45


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    w = LogWriter(str(tmp_path), "a")
    batch = pa.RecordBatch.from_pydict({"url": ["u", "v"]})
    first, second, none = w.write(iter([batch])), w.write(iter([batch, batch])), w.write(iter([]))
    assert none == Written(None) and texts(tmp_path) == []
    w.commit([second, none])
    assert first.name != second.name and texts(tmp_path) == ['"url"\n' + '"u"\n"v"\n' * 2]
    late = LogWriter(str(tmp_path), "a")
    late.commit([late.write(iter([batch]))])
    assert len(texts(tmp_path)) == 1 and list((tmp_path / "_staging").iterdir()) == []


def test_a_stream_that_repeats_a_batch(spark, tmp_path):
    path = str(tmp_path / "log")

    def sink(df, epoch):
        for _ in range(2):
            S2.append_download_log(df, path, f"stream-{epoch}")

    (tmp_path / "in").mkdir()
    for k in range(3):
        rows(spark, 10).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(S2.DOWNLOAD_LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert query.awaitTermination(60)
    assert S2.read_download_log(spark, path).count() == 30 and len(list((tmp_path / "log").glob("batch-stream-*"))) == 3
