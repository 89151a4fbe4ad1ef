"""Other sources and sinks (SRC-3, SRC-5 to SRC-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .log import LogSource

POSITION = "struct<x:double,y:double>"
PROPERTY = "struct<name:string,value:string>"
SYMBOL = f"struct<id:string,properties:map<string,{PROPERTY}>>"
COMPONENT = f"struct<reference:string,value:string,footprint:string,position:{POSITION},rotation:double,library_id:string,properties:map<string,{PROPERTY}>>"
WIRE = f"struct<start:{POSITION},end:{POSITION}>"
NET = f"struct<name:string,pins:array<array<string>>,wires:array<{WIRE}>,labels:array<struct<text:string,type:string>>>"
DOCUMENT = f"metadata struct<title_block:map<string,string>,generator:string,paper:string>, library_symbols map<string,{SYMBOL}>, components map<string,{COMPONENT}>, nets map<string,{NET}>"
#: The parts of a document that have links.
LINKED = DOCUMENT[: DOCUMENT.index(", nets ")]
ANALYSIS = "analysis struct<components:array<struct<reference:string,value:string,description:string,mpn:string>>,nets:array<struct<name:string,net_type:string,connected_components:array<string>>>,functional_groups:array<struct<name:string,function:string,description:string,components:array<string>>>>"

DOWNLOAD_LOG = "timestamp string, filename string, url string, manufacturer string, category string, part_number string, status string, script_version string, error_message string"
TARGETS = "name string, website string, category string"


def over_defaults(settings: Column, defaults: dict[str, Column]) -> Column:
    """SRC-3: a struct of settings with the default where a field is missing."""
    return F.struct(*[F.coalesce(settings[k], v).alias(k) for k, v in defaults.items()])


def read_settings(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-3: whole JSON files, with their path."""
    return spark.read.option("multiLine", "true").schema(schema).json(path).select("*", "_metadata.file_path")


def document_texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """SRC-5: (schematic_id, json): one row a file."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("schematic_id"), F.col("value").alias("json"))


def not_json(text: str) -> Column:
    """What is wrong with a text that cannot be read; null with one that can."""
    return F.when(F.try_parse_json(text).isNull(), "not JSON")


def documents(texts: DataFrame) -> DataFrame:
    """SRC-5: JSON texts (schematic_id, json) as typed documents; ``error`` says why one could not be read."""
    parsed = texts.withColumn("d", F.from_json("json", DOCUMENT)).withColumn("error", not_json("json"))
    return parsed.select("schematic_id", "error", "d.*")


def document_symbols(docs: DataFrame) -> DataFrame:
    """(schematic_id, ordinal, symbol_id, properties) of typed documents."""
    own = docs.select("schematic_id", F.explode(F.map_entries(F.coalesce("library_symbols", F.create_map().cast(f"map<string,{SYMBOL}>")))).alias("e"))
    return own.select("schematic_id", F.lit(0).alias("ordinal"), F.col("e.key").alias("symbol_id"), _values("e.value.properties").alias("properties"))


def document_components(docs: DataFrame) -> DataFrame:
    """(schematic_id, ordinal, reference, value, ..., properties) of typed documents."""
    own = docs.select("schematic_id", F.posexplode(F.map_entries("components")).alias("ordinal", "e"))
    return own.select("schematic_id", "ordinal", F.col("e.key").alias("reference"), "e.value.value", "e.value.footprint", "e.value.library_id", F.col("e.value.position.x").alias("x"), F.col("e.value.position.y").alias("y"), "e.value.rotation", _values("e.value.properties").alias("properties"))


def document_nets(docs: DataFrame) -> DataFrame:
    """(schematic_id, ordinal, name, connected_components, labels, wires) of typed documents."""
    own = docs.select("schematic_id", F.posexplode(F.map_entries("nets")).alias("ordinal", "e"))
    refs = F.transform(F.coalesce("e.value.pins", F.array().cast("array<array<string>>")), lambda p: F.get(p, F.lit(0)))
    return own.select("schematic_id", "ordinal", F.col("e.key").alias("name"), refs.alias("connected_components"), F.col("e.value.labels").alias("labels"), F.col("e.value.wires").alias("wires"))


def _values(properties: str) -> Column:
    p = F.coalesce(F.col(properties), F.create_map().cast(f"map<string,{PROPERTY}>"))
    return F.map_from_entries(F.transform(F.map_entries(p), lambda e: F.struct(e["key"], e["value"]["value"])))


def analysis_part(texts: DataFrame, part: str) -> DataFrame:
    """SRC-6: the rows of components, nets or functional_groups of analysis JSON; a missing part has none."""
    own = texts.select("schematic_id", F.from_json("json", ANALYSIS)["analysis"][part].alias("a"))
    return own.select("schematic_id", F.explode("a").alias("r")).select("schematic_id", "r.*")


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """SRC-7: (source_file, file_path, processing_date, text); a file that cannot be read is skipped, an empty one gives no row."""
    raw = spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("file_path"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("processing_date"), F.col("value").alias("text"))


def pages_for(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """SRC-8: the fetched pages of some URLs."""
    return pages.join(urls.select("url").distinct(), "url", "left_semi")


def read_download_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: all batches of a log; an empty field is null."""
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("recursiveFileLookup", "true").schema(DOWNLOAD_LOG).csv(path)


def append_download_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """SRC-9: rows are appended exactly once; every file starts with the header. A batch of a name that the log has already is left out."""
    spark = rows.sparkSession
    spark.dataSource.register(LogSource)
    names = [f.split()[0] for f in DOWNLOAD_LOG.split(", ")]
    own = rows.select(*[F.col(n).cast("string").alias(n) for n in names])
    own.write.format(LogSource.name()).mode("append").options(path=path, **{"batch": batch} if batch else {}).save()


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10."""
    return spark.read.option("multiLine", "true").schema(TARGETS).json(path)


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """SRC-11: a relational table; filters and columns are pushed down, reads are split by a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """SRC-11."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_jsonl(df: DataFrame, path: str) -> None:
    """SRC-12."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SRC-13."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_per_source(df: DataFrame, path: str, key: str = "source_file") -> None:
    """SRC-14: JSON below a folder for each source."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def with_header(responses: DataFrame, now: Column) -> DataFrame:
    """SRC-15: (value): texts between a header with their metadata and a footer, to be written as text."""
    line = "=" * 80
    return responses.select(F.concat_ws("\n", F.lit(line), F.lit("RAW ANALYSIS RESPONSE"), F.lit(line), F.concat(F.lit("Source: "), "source_file"), F.concat(F.lit("Timestamp: "), F.date_format(now, "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("Length: "), F.length("text").cast("string"), F.lit(" characters")), F.lit(line), F.lit(""), F.col("text"), F.lit(""), F.lit(line), F.lit("END OF RESPONSE"), F.lit(line)).alias("value"))


def as_messages(rows: DataFrame, attributes: dict[str, Column], key: str | None = None) -> DataFrame:
    """SRC-16: (key, value, headers) ready for a queue: the row as JSON, attributes as headers."""
    heads = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v.cast("string"), "utf-8").alias("value")) for k, v in attributes.items()])
    return rows.select((F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), heads.alias("headers"))
