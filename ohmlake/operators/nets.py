"""Nets from wires (NET-1 to NET-7).

wires: (schematic_id, ordinal, x1, y1, x2, y2); junctions: (schematic_id, ordinal, x, y); labels: (schematic_id,
ordinal, text, type, x, y, rotation); pins: (schematic_id, reference, number, x, y), positions already absolute.

Joins are by sort and merge: what these tables are made of compresses well, so by its files the planner takes it for small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ohmlake.functions.columns import ordered
from ohmlake.plans.components import connected_components
from ohmlake.plans.forest import spanning_forest
from ohmlake.plans.grid import near

TOLERANCE = 0.01
BY = ["schematic_id"]
#: Fixed value: cells of so many tolerances, as wire ends lie on a drawing's grid, which is much wider.
CELL = 4.0


def endpoints(wires: DataFrame) -> DataFrame:
    """(schematic_id, ordinal, x, y): both ends of each wire, once if they are one point."""
    ends = F.array_distinct(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return wires.select("schematic_id", "ordinal", F.explode(ends).alias("p")).select("schematic_id", "ordinal", "p.x", "p.y")


def touching(wires: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """NET-1: (schematic_id, a, b) with a < b for wires of which two ends are within the tolerance.

    Ends at the very same point chain to the next wire there rather than all to all; the chain has the same
    components. Only different points are compared.
    """
    ends = endpoints(wires)
    at = Window.partitionBy("schematic_id", "x", "y").orderBy("ordinal")
    chain = ends.withColumn("b", F.col("ordinal")).withColumn("a", F.lag("ordinal").over(at)).where("a is not null and a <> b").select("schematic_id", "a", "b")
    points = ends.groupBy("schematic_id", "x", "y").agg(F.min("ordinal").alias("first"))
    other = points.toDF("schematic_id", "ox", "oy", "other")
    pairs = near(points, other, tolerance, BY, "x", "y", "ox", "oy", CELL).where("(x <> ox or y <> oy) and first <> other")
    return chain.unionByName(pairs.select("schematic_id", F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b"))).distinct()


def node(schematic: str = "schematic_id", ordinal: str = "ordinal") -> Column:
    return F.concat_ws(":", F.col(schematic).cast("string"), F.lpad(F.col(ordinal).cast("string"), 12, "0"))


def wire_groups(wires: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """NET-2: (schematic_id, ordinal, wire_group): group is the node of the group's first wire."""
    edges = touching(wires, tolerance).select(node("schematic_id", "a").alias("a"), node("schematic_id", "b").alias("b"))
    parts = connected_components(edges)
    own = wires.select("schematic_id", "ordinal", node().alias("node"))
    return own.join(parts.hint("merge"), "node", "left").select("schematic_id", "ordinal", F.coalesce("component", "node").alias("wire_group"))


def net_numbers(wires: DataFrame, groups: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """NET-3: (schematic_id, wire_group, net_id, name): groups in the order of a list to whose end merged groups move.

    Wires come in order; one that touches several groups merges them. A group's place is the ordinal of the last wire that merged
    groups, else of its first wire. With a touching pair weighed by its later wire, a wire has as many edges in a minimum
    spanning forest as there were groups that it touched: with two or more it merged them.
    """
    forest = spanning_forest(touching(wires, tolerance), BY)
    merging = forest.groupBy("schematic_id", F.col("b").alias("ordinal")).agg(F.count("*").alias("n")).where("n > 1").select("schematic_id", "ordinal", F.col("ordinal").alias("merged"))
    placed = groups.join(merging.hint("merge"), ["schematic_id", "ordinal"], "left").groupBy("schematic_id", "wire_group").agg(F.coalesce(F.max("merged"), F.min("ordinal")).alias("place"))
    net_id = F.row_number().over(Window.partitionBy("schematic_id").orderBy("place")) - 1
    return placed.select("schematic_id", "wire_group", net_id.cast("long").alias("net_id"), F.concat(F.lit("Net_"), net_id.cast("string")).alias("name"))


def on_nets(points: DataFrame, keys: list[str], wires: DataFrame, groups: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """NET-4, NET-5, NET-6: (schematic_id, wire_group, keys) for points (x, y) at a wire's end of the group."""
    ends = endpoints(wires).join(groups.hint("merge"), ["schematic_id", "ordinal"]).select("schematic_id", "wire_group", F.col("x").alias("wx"), F.col("y").alias("wy")).distinct()
    own = points.select("schematic_id", *keys, F.col("x").alias("px"), F.col("y").alias("py"))
    return near(own, ends, tolerance, BY, "px", "py", "wx", "wy", CELL).select("schematic_id", "wire_group", *keys).distinct()


def pin_positions(components: DataFrame, pins: DataFrame, compat: bool = True) -> DataFrame:
    """NET-6: absolute pin places: the component's place plus the pin's offset; without compat also turned by its rotation."""
    own = pins.join(components.select("schematic_id", "reference", F.col("x").alias("cx"), F.col("y").alias("cy"), F.radians("rotation").alias("turn")), ["schematic_id", "reference"])
    if compat:
        return own.select("schematic_id", "reference", "number", (F.col("cx") + F.col("x")).alias("x"), (F.col("cy") + F.col("y")).alias("y"))
    c, s = F.cos("turn"), F.sin("turn")
    return own.select("schematic_id", "reference", "number", (F.col("cx") + F.col("x") * c + F.col("y") * s).alias("x"), (F.col("cy") - F.col("x") * s + F.col("y") * c).alias("y"))


def nets(wires: DataFrame, junctions: DataFrame, labels: DataFrame, pins: DataFrame, tolerance: float = TOLERANCE, compat: bool = True) -> DataFrame:
    """NET-7: (schematic_id, net_id, name, pins, wires, junctions, labels), lists in document order.

    Without compat a net is called by its first label.
    """
    groups = wire_groups(wires, tolerance)
    numbers = net_numbers(wires, groups, tolerance)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    own_wires = wires.join(groups.hint("merge"), ["schematic_id", "ordinal"]).groupBy("schematic_id", "wire_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", point("x1", "y1").alias("start"), point("x2", "y2").alias("end")))), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))).alias("wires"))
    own_pins = on_nets(pins, ["reference", "number"], wires, groups, tolerance).groupBy("schematic_id", "wire_group").agg(F.array_sort(F.collect_list(F.struct(F.col("reference").alias("ref"), F.col("number").alias("pin")))).alias("pins"))
    on_j = on_nets(junctions, ["ordinal"], wires, groups, tolerance).join(junctions.hint("merge"), ["schematic_id", "ordinal"])
    own_j = on_j.groupBy("schematic_id", "wire_group").agg(ordered(F.struct("ordinal", point("x", "y").alias("p")), "p").alias("junctions"))
    on_l = on_nets(labels, ["ordinal"], wires, groups, tolerance).join(labels.hint("merge"), ["schematic_id", "ordinal"])
    own_l = on_l.groupBy("schematic_id", "wire_group").agg(ordered(F.struct("ordinal", F.struct("text", "type", "x", "y").alias("l")), "l").alias("labels"))
    out = numbers.join(own_wires.hint("merge"), ["schematic_id", "wire_group"])
    for part in (own_pins, own_j, own_l):
        out = out.join(part.hint("merge"), ["schematic_id", "wire_group"], "left")
    first = F.get(F.filter("labels", lambda x: F.coalesce(x["text"], F.lit("")) != ""), F.lit(0))["text"]
    name = F.col("name") if compat else F.coalesce(first, F.col("name"))
    return out.select("schematic_id", "net_id", name.alias("name"), "pins", "wires", "junctions", "labels")
