"""Project and schematic viewer operators (PRJ-1 to PRJ-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import keep_first, natural_key
from ohmlake.plans.storage import stored


def sheet_paths(files: DataFrame, sheets: DataFrame, instances: DataFrame) -> DataFrame:
    """PRJ-1: (project_id, path, filename, sheetname, page, instance_path) for sheets whose file exists.

    files: (project_id, filename, uuid); sheets: (project_id, owner, sheet_uuid, sheetfile, sheetname);
    instances: (project_id, sheet_uuid, path, page).
    """
    there = files.select("project_id", F.col("filename").alias("sheetfile"))
    own = sheets.join(there, ["project_id", "sheetfile"], "left_semi").join(instances, ["project_id", "sheet_uuid"])
    return own.select("project_id", F.concat("path", F.lit("/"), "sheet_uuid").alias("path"), F.col("sheetfile").alias("filename"), F.coalesce("sheetname", "sheetfile").alias("sheetname"), F.coalesce("page", F.lit("")).alias("page"), F.col("path").alias("instance_path"), "owner")


def reachable(roots: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """PRJ-2: (by, node) that links (by, node, to) reach from roots (by, node), the roots included.

    Breadth first: each round joins only what the last one found, drops what is known and writes what is new.
    Tables of many rounds are put together now and then. Cycles end; chains may be of any depth.
    """
    step = stored(links.select(*by, "node", "to").distinct(), "links")
    new = stored(roots.select(*by, "node").distinct(), "reached")
    found = [new]
    while True:
        seen = reduce(DataFrame.unionByName, found)
        new = stored(new.join(step, [*by, "node"]).select(*by, F.col("to").alias("node")).distinct().join(seen, [*by, "node"], "left_anti"), "reached")
        if new.isEmpty():
            return seen
        found = [*found, new] if len(found) < 16 else [stored(seen, "reached"), new]


def roots(files: DataFrame, paths: DataFrame) -> DataFrame:
    """PRJ-3: (project_id, filename, path): the schematic at the parent of the shortest sheet path that has one."""
    known = files.select("project_id", F.concat(F.lit("/"), "uuid").alias("parent"), F.col("filename").alias("root")).unionByName(paths.select("project_id", F.col("instance_path").alias("parent"), F.col("owner").alias("root")))
    own = paths.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).where("parent <> ''").join(known.distinct(), ["project_id", "parent"])
    first = keep_first(own, ["project_id"], [F.length("path"), "path", "root"])
    return first.join(files.select("project_id", F.col("filename").alias("root"), "uuid"), ["project_id", "root"]).select("project_id", F.col("root").alias("filename"), F.concat(F.lit("/"), "uuid").alias("path"))


def pages(files: DataFrame, paths: DataFrame) -> DataFrame:
    """PRJ-4: (project_id, place, path, filename, name, page): the root as page 1, instances by page number, then orphans."""
    root = roots(files, paths)
    top = root.select("project_id", "path", "filename", F.lit("Root").alias("name"), F.lit("1").alias("page"))
    placed = paths.join(root.select("project_id"), "project_id", "left_semi").select("project_id", "path", "filename", F.col("sheetname").alias("name"), "page")
    hier = top.withColumn("_k", F.lit(0)).unionByName(placed.withColumn("_k", F.lit(1)))
    orphans = files.join(hier.select("project_id", "filename").distinct(), ["project_id", "filename"], "left_anti").select("project_id", F.concat(F.lit("/"), "uuid").alias("path"), "filename", F.col("filename").alias("name"), F.lit("").alias("page"))
    every = hier.withColumn("_o", F.lit(0)).unionByName(orphans.withColumns({"_k": F.lit(2), "_o": F.lit(1)}))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("_o", natural_key("page"), "_k", "path"))
    return every.withColumn("place", place).select("project_id", "place", "path", "filename", "name", "page")


def with_instance_overrides(symbols: DataFrame, root_instances: DataFrame, global_instances: DataFrame, symbol_instances: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """PRJ-5: symbols with each field from the first instance row there is (root, global, own), else their own value."""
    out = symbols
    for i, table in enumerate((root_instances, global_instances, symbol_instances)):
        out = out.join(table.select(*on, F.struct(*fields).alias(f"_i{i}")), on, "left")
    row = F.coalesce("_i0", "_i1", "_i2")
    return out.withColumns({f: F.coalesce(row[f], F.col(f)) for f in fields}).drop("_i0", "_i1", "_i2")


def sorted_naturally(rows: DataFrame, column: str) -> DataFrame:
    """PRJ-6: rows with the key that sorts R2 before R10."""
    return rows.withColumn("sort_key", natural_key(column))


def text_filter(rows: DataFrame, columns: list[str], query: str | Column) -> DataFrame:
    """PRJ-7: rows whose joined texts contain the query, without regard to case."""
    q = F.lit(query) if isinstance(query, str) else query
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(F.lower(q)))


def found(items: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """PRJ-8: for each key (by, key) the item whose uuid it is, else the first whose reference it is."""
    a = keys.join(items, [*[keys[c] == items[c] for c in by], keys["key"] == items["uuid"]]).select(*[keys[c] for c in by], "key", F.lit(0).alias("_r"), items["uuid"], items["reference"])
    b = keys.join(items, [*[keys[c] == items[c] for c in by], keys["key"] == items["reference"]]).select(*[keys[c] for c in by], "key", F.lit(1).alias("_r"), items["uuid"], items["reference"])
    return keep_first(a.unionByName(b), [*by, "key"], ["_r", "uuid"]).drop("_r")


def symbol_list(symbols: DataFrame, libraries: DataFrame) -> DataFrame:
    """PRJ-9: symbols with is_power of their library symbol and a sort key: normal ones first, each in natural order."""
    own = symbols.join(libraries.select("library_id", "is_power"), "library_id", "left").withColumn("is_power", F.coalesce("is_power", F.lit(False)))
    return own.withColumn("sort_key", F.concat(F.col("is_power").cast("int").cast("string"), natural_key("reference")))


def expanded(texts: DataFrame, variables: DataFrame, by: list[str], text: str = "text", text_id: str = "text_id") -> DataFrame:
    """PRJ-10: texts with ${NAME} replaced from variables (by, scope, name, value); the least scope wins, unknown names stay.

    Scopes number the places a name is looked up in: symbol, special names, cross references, document, title block.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    parts = F.regexp_extract_all(text_, F.lit(r"(\$\{[^}]*\}|\$(?!\{[^}]*\})|[^$]+)"), F.lit(1))
    rows = texts.select(*by, text_id, F.posexplode_outer(parts).alias("i", "part"))
    rows = rows.withColumn("name", F.nullif(F.regexp_extract(F.coalesce("part", F.lit("")), r"^\$\{([^}]*)\}\z", 1), F.lit("")))
    best = variables.groupBy(*by, "name").agg(F.min_by("value", "scope").alias("value"))
    filled = rows.join(best, [*by, "name"], "left").withColumn("part", F.coalesce("value", "part", F.lit("")))
    joined = filled.groupBy(*by, text_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("i", F.lit(0)).alias("i"), "part"))), lambda x: x["part"]), "").alias("expanded"))
    return texts.join(joined, [*by, text_id])


def unit_pins(symbols: DataFrame, pins: DataFrame) -> DataFrame:
    """PRJ-12: pins of each symbol's unit; a pin of unit 0 or none belongs to all."""
    p = pins.withColumnRenamed("unit", "pin_unit")
    own = symbols.join(p, "library_id")
    return own.where(F.coalesce("pin_unit", F.lit(0)).isin(0) | F.coalesce("unit", F.lit(0)).isin(0) | (F.col("pin_unit") == F.col("unit"))).drop("pin_unit")


def summary(symbols: DataFrame, others: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """PRJ-13: (by, symbols, unique_symbols, a count for each other table)."""
    out = symbols.groupBy(*by).agg(F.count("*").alias("symbols"), F.countDistinct("library_id").alias("unique_symbols"))
    for name, table in others.items():
        out = out.join(table.groupBy(*by).agg(F.count("*").alias(name)), by, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in others})


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
