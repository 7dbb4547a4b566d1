"""Joins of boxes on a page by grid cells, so that no box meets all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")


def _dealt(rows: DataFrame, cell: float) -> DataFrame:
    """Each box to every cell that it covers."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return rows.where("x0 <= x1 AND y0 <= y1").withColumn("cell_x", span("x0", "x1")).withColumn("cell_y", span("y0", "y1"))


def meeting(left: DataFrame, right: DataFrame, key: list[str], cell: float = 128.0) -> DataFrame:
    """All pairs of boxes of one key that touch, once each.

    Both sides have ``key``, x0, y0, x1, y1 and columns of their own; the result has the right side's edges as
    r_x0 ... r_y1. A pair may share several cells; it counts in the one that holds the corner of its intersection.
    Boxes without area touch as lines and points do; boxes with a null edge, or ends before their starts, meet nothing.
    """
    other = _dealt(right, cell).select(*(F.col(c).alias(f"r_{c}" if c in EDGES else c) for c in right.columns), "cell_x", "cell_y")
    met = _dealt(left, cell).join(other, [*key, "cell_x", "cell_y"])
    touch = (F.col("x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("x1")) & (F.col("y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("y1"))
    corner = (F.floor(F.greatest("x0", "r_x0") / cell) == F.col("cell_x")) & (F.floor(F.greatest("y0", "r_y0") / cell) == F.col("cell_y"))
    return met.where(touch & corner).drop("cell_x", "cell_y")
