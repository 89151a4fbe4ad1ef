"""Keyed tables of which an upsert rewrites only the buckets that its keys fall in (VEC-7).

A table is a folder: data/<generation>/_bucket=<n>/ holds Parquet files, and manifest-<version>.json says which generation each
bucket is read from. Files are never changed. A writer puts its buckets into a generation of its own and then a manifest in
place by one rename, which fails if another writer was first. Readers take the newest manifest, so that one that has begun
goes on seeing its own version, until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .storage import _place

#: Rows that a bucket has about when a table is made.
BUCKET_ROWS = 100_000


def bucket(keys: list[str], buckets: int) -> Column:
    """The bucket of a row; null keys have one, too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    place, system = _place(spark, folder)
    if not system.exists(place):
        return []
    names = [f.getPath().getName() for f in system.listStatus(place)]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What the newest manifest, or that of a version, says: version, keys, buckets, schema, and the generation of each bucket with rows."""
    found = _manifests(spark, folder)
    if not found:
        raise ValueError(f"no table at {folder}")
    return json.loads(spark.read.option("wholetext", "true").text(f"{folder}/manifest-{found[-1] if version is None else version}.json").first()[0])


def _commit(spark: SparkSession, folder: str, said: dict) -> None:
    name = f"{folder}/manifest-{said['version']}.json"
    half, system = _place(spark, f"{folder}/_{uuid.uuid4().hex}.json")
    out = system.create(half)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    to, _ = _place(spark, name)
    if system.exists(to) or not system.rename(half, to):
        system.delete(half, False)
        raise ValueError(f"another writer has made version {said['version']} of {folder}")


def _written(df: DataFrame, folder: str, said: dict) -> list[int]:
    """Write the buckets of df as a new generation; the numbers of those that have rows."""
    generation = uuid.uuid4().hex
    at = f"{folder}/data/{generation}"
    df.withColumn("_bucket", bucket(said["keys"], said["buckets"])).repartition("_bucket").write.partitionBy("_bucket").parquet(at)
    place, system = _place(df.sparkSession, at)
    names = [f.getPath().getName() for f in system.listStatus(place)]
    own = [int(n.partition("=")[2]) for n in names if n.startswith("_bucket=")]
    said["generations"] |= {str(b): generation for b in own}
    return own


def create(df: DataFrame, folder: str, keys: list[str], buckets: int | None = None) -> None:
    """A new table of df, whose keys are taken to be unique; as many buckets as make BUCKET_ROWS each, unless given."""
    count = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    said = {"version": 1, "keys": keys, "buckets": count, "schema": df.schema.jsonValue(), "generations": {}}
    _written(df, folder, said)
    _commit(df.sparkSession, folder, said)


def read(spark: SparkSession, folder: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table as of its newest or a given version, or some of its buckets."""
    said = manifest(spark, folder, version)
    schema = StructType.fromJson(said["schema"])
    wanted = said["generations"] if only is None else {str(b): g for b in only if (g := said["generations"].get(str(b)))}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/data/{g}/_bucket={b}" for b, g in wanted.items()])


def upsert(new: DataFrame, folder: str) -> list[int]:
    """VEC-7: put the rows of new in or over the table's by key; the numbers of the buckets that were written.

    Of rows of new with one key the last by all columns stays. Only buckets that new has keys of are read and written. No rows: no version.
    """
    spark = new.sparkSession
    said = manifest(spark, folder)
    keys, names = said["keys"], [f["name"] for f in said["schema"]["fields"]]
    touched = [r[0] for r in new.select(bucket(keys, said["buckets"]).alias("b")).distinct().collect()]  # as many as there are buckets
    if not touched:
        return []
    rest = [F.col(c).desc() for c in names if new.schema[c].dataType.typeName() not in ("map", "variant")]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    own = new.select(*names).withColumn("_n", last).where("_n = 1").drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    put = own.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    kept = read(spark, folder, said["version"], touched).join(put, same, "left_anti")
    written = _written(kept.unionByName(own), folder, said)
    said["version"] += 1
    _commit(spark, folder, said)
    return written


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete what the newest version does not read, older manifests first; the number of generations deleted."""
    versions = _manifests(spark, folder)
    live = set(manifest(spark, folder)["generations"].values())
    for v in versions[:-1]:
        place, system = _place(spark, f"{folder}/manifest-{v}.json")
        system.delete(place, False)
    place, system = _place(spark, f"{folder}/data")
    dead = [f.getPath() for f in system.listStatus(place) if f.getPath().getName() not in live]
    for path in dead:
        system.delete(path, True)
    return len(dead)
