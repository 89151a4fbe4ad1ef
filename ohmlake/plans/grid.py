"""Tolerance and containment joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cell(x: str | Column, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(size)).cast("bigint")


def near(a: DataFrame, b: DataFrame, tolerance: float, by: list[str], ax: str, ay: str, bx: str, by_: str, width: float = 1.0) -> DataFrame:
    """Pairs of rows whose points are within a Euclidean tolerance (inclusive), within the same ``by``.

    Points of b stand in one cell, those of a in all that the tolerance reaches, so the join is an equi-join on (by, cell); the
    exact distance is tested after it. Columns of a and b other than by must differ. ``width``: tolerances to a cell's side. Cells of one
    have the fewest candidates and nine rows of a for each point; where points are sparse, wider cells have fewer rows. Both sides
    are shuffled: the planner takes points for as small as the files they come from, and would broadcast them.
    """
    reach = max(tolerance, 1e-9) * 1.0000001
    size = reach * width
    at = lambda x: F.floor(x / F.lit(size) + F.lit(0.5)).cast("bigint")  # noqa: E731  round coordinates lie inside of cells
    reached = lambda c: F.sequence(at(F.col(c) - F.lit(reach)), at(F.col(c) + F.lit(reach)))
    finite = lambda c: F.abs(c) < F.lit(float("inf"))  # noqa: E731  nothing is near a place that is none
    cells = F.explode(F.flatten(F.transform(reached(ax), lambda i: F.transform(reached(ay), lambda j: F.struct(i.alias("cx"), j.alias("cy"))))))
    left = a.where(finite(ax) & finite(ay)).withColumn("_c", cells).withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c")
    right = b.withColumns({"_cx": at(F.col(bx)), "_cy": at(F.col(by_))})
    d = F.sqrt(F.pow(F.col(ax) - F.col(bx), F.lit(2.0)) + F.pow(F.col(ay) - F.col(by_), F.lit(2.0)))
    return left.join(right.hint("merge"), [*by, "_cx", "_cy"]).where(d <= tolerance).drop("_cx", "_cy")


def containing(points: DataFrame, boxes: DataFrame, size: float, by: list[str], px: str, py: str, box: tuple[str, str, str, str], most_cells: int = 4096) -> DataFrame:
    """Pairs of points and boxes (x1, y1, x2, y2) that hold them, borders included.

    A box stands in every cell it covers; boxes that cover more than ``most_cells`` take coarser cells, each
    level with its own join key, so that a large box costs no more rows than a small one.
    """
    x1, y1, x2, y2 = box
    span = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)) / F.lit(size)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(1.0)) / F.lit(float(most_cells) ** 0.5 / 2)))).cast("int")
    boxes = boxes.withColumn("_level", level)
    levels = [r[0] for r in boxes.select("_level").distinct().collect()]  # as many as the sizes span in powers of two
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("_level"))
    at = lambda c: F.floor(F.col(c) / step).cast("bigint")
    cells = F.flatten(F.transform(F.sequence(at(x1), at(x2)), lambda i: F.transform(F.sequence(at(y1), at(y2)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
    right = boxes.where(f"{x1} <= {x2} and {y1} <= {y2}").withColumn("_c", F.explode(cells)).withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c")
    left = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumns({"_cx": at(px), "_cy": at(py)})
    inside = (F.col(px) >= F.col(x1)) & (F.col(px) <= F.col(x2)) & (F.col(py) >= F.col(y1)) & (F.col(py) <= F.col(y2))
    return left.join(right, [*by, "_level", "_cx", "_cy"]).where(inside).drop("_cx", "_cy", "_level")
