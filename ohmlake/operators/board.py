"""Board operators (BRD-1 to BRD-8). Boxes are columns x1, y1, x2, y2; an empty box has x1 > x2 or y1 > y2, or a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import natural_key
from ohmlake.operators.project import union_all
from ohmlake.plans.grid import containing

# Layers of the front side and of the outline.
FRONT, OUTLINE = "F.Cu", "Edge.Cuts"


def net_members(tables: dict[str, DataFrame], nets: DataFrame | None = None) -> DataFrame:
    """BRD-1: (board_id, net, entity, ordinal) of segments, arcs, vias, zones and pads on nets with a number above 0."""
    every = union_all([t.select("board_id", "net", F.lit(e).alias("entity"), "ordinal") for e, t in tables.items()]).where("net > 0")
    return every if nets is None else every.join(nets.select("board_id", "net").distinct(), ["board_id", "net"], "left_semi")


def footprints_by_side(footprints: DataFrame) -> DataFrame:
    """BRD-2: footprints with side, defaults for a missing reference or value, and a natural sort key."""
    blank = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c))
    own = footprints.withColumns({"side": F.when(F.col("layer") == FRONT, "Front").otherwise("Back"), "reference": blank("reference", "REF"), "value": blank("value", "VAL")})
    return own.withColumn("sort_key", natural_key("reference"))


def not_empty() -> Column:
    return F.coalesce((F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")), F.lit(False))


def combined_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    """BRD-3: (by, x1, y1, x2, y2) around all boxes that are not empty; zeros if all are."""
    ok = not_empty()
    side = lambda f, c: F.coalesce(f(F.when(ok, F.col(c))), F.lit(0.0)).alias(c)
    return boxes.groupBy(*by).agg(side(F.min, "x1"), side(F.min, "y1"), side(F.max, "x2"), side(F.max, "y2"))


def _ordered(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"x1": F.least("x1", "x2"), "y1": F.least("y1", "y2"), "x2": F.greatest("x1", "x2"), "y2": F.greatest("y1", "y2")})


def outline(drawings: DataFrame, by: list[str]) -> DataFrame:
    """BRD-4: (by, width, height) of the drawings on the outline layer."""
    box = combined_box(_ordered(drawings.where(F.col("layer") == OUTLINE)), by)
    return box.select(*by, (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))


def footprint_boxes(footprints: DataFrame, drawings: DataFrame, by: list[str], seed: float = 0.5) -> DataFrame:
    """BRD-5: (by, reference, box): a square of half side ``seed`` and the drawings, turned and moved to the footprint's place."""
    own = _ordered(drawings).groupBy(*by, "reference").agg(F.min("x1").alias("ax"), F.min("y1").alias("ay"), F.max("x2").alias("bx"), F.max("y2").alias("by_"))
    f = footprints.join(own, [*by, "reference"], "left")
    f = f.withColumns({"ax": F.least(F.coalesce("ax", F.lit(-seed)), F.lit(-seed)), "ay": F.least(F.coalesce("ay", F.lit(-seed)), F.lit(-seed)), "bx": F.greatest(F.coalesce("bx", F.lit(seed)), F.lit(seed)), "by_": F.greatest(F.coalesce("by_", F.lit(seed)), F.lit(seed))})
    c, s = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    corners = F.array(*[F.struct((F.col("x") + F.col(px) * c + F.col(py) * s).alias("x"), (F.col("y") - F.col(px) * s + F.col(py) * c).alias("y")) for px in ("ax", "bx") for py in ("ay", "by_")])
    f = f.withColumn("_c", corners)
    xs, ys = F.col("_c.x"), F.col("_c.y")
    return f.select(*by, "reference", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def hits(points: DataFrame, items: DataFrame, by: list[str], size: float) -> DataFrame:
    """BRD-6: pairs of points (by, point_id, px, py) and items (by, item_id, layer_order, box) that hold them, with rank by layer.

    The join is on grid cells of the given size.
    """
    pairs = containing(points, items, size, by, "px", "py", ("x1", "y1", "x2", "y2"))
    rank = F.row_number().over(Window.partitionBy(*by, "point_id").orderBy("layer_order", "item_id"))
    return pairs.withColumn("rank", rank).select(*by, "point_id", "item_id", "layer_order", "rank")


def board_summary(tables: dict[str, DataFrame], drawings: DataFrame, by: list[str]) -> DataFrame:
    """BRD-7: (by, a count for each table, width, height), zeros where a board has none."""
    counts = union_all([t.select(*by, F.lit(n).alias("_e")) for n, t in tables.items()]).groupBy(*by).pivot("_e", list(tables)).count()
    return counts.join(outline(drawings, by), by, "left").na.fill(0)


def footprint_facts(footprints: DataFrame, pads: DataFrame, by: list[str]) -> DataFrame:
    """BRD-8: footprints with type, number of pads and attributes (tags, split)."""
    n = pads.groupBy(*by, "reference").agg(F.count("*").alias("pads"))
    tags = F.coalesce("tags", F.lit(""))
    kind = F.when(tags.contains("through_hole"), "through hole").when(tags.contains("smd"), "smd").otherwise("unspecified")
    return footprints.join(n, [*by, "reference"], "left").withColumns({"pads": F.coalesce("pads", F.lit(0).cast("long")), "kind": kind, "attributes": F.filter(F.split(tags, " "), lambda x: x != "")})
