"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local runs without a setting, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a local one if all of Spark is on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _LOCAL[spark.sparkContext.applicationId] = folder = tempfile.mkdtemp(prefix="ohmlake-")
    return folder


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Spark's JVM knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when Spark ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` early, once all that was made of them is stored itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            place, system = _place(df.sparkSession, folder)
            system.delete(place, True)
