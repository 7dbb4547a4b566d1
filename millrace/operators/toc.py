"""Tables of contents as flat rows (key, seq, level, title, page): parents, boundaries, spans, unique titles.

A tree stays flat: windows over (key, seq) find what a stack would. Levels start at 1; ``depth`` bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_parents(toc: DataFrame, key: str, depth: int) -> DataFrame:
    """``parent_seq``: the last earlier row of a lesser level, null for roots; ``leaf``: no row below follows."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.col("seq")), ignorenulls=True).over(before) for n in range(1, depth)}
    parent = F.lit(None).cast("int")
    for n in range(2, depth + 1):
        above = [last[m] for m in range(1, n)]
        parent = F.when(F.col("level") == n, F.greatest(*above) if len(above) > 1 else above[0]).otherwise(parent)
    deeper = F.lead("level").over(Window.partitionBy(key).orderBy("seq"))
    return toc.withColumn("parent_seq", parent).withColumn("leaf", F.coalesce(deeper <= F.col("level"), F.lit(True)))


def boundaries(toc: DataFrame, key: str, depth: int, forced: Column, most: int = 2) -> DataFrame:
    """Rows at which sections begin: leaves and rows of level ``most``; below a root with ``forced`` only leaves."""
    rows = with_parents(toc, key, depth)
    so_far = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    root = F.last(F.when(F.col("level") == 1, forced), ignorenulls=True).over(so_far)
    marked = rows.withColumn("forced", F.coalesce(root, F.lit(False)))
    keep = F.when(F.col("forced"), F.col("leaf")).otherwise((F.col("level") == most) | (F.col("leaf") & (F.col("level") < most)))
    return marked.where(keep)


def spans(sections: DataFrame, key: str, last_page: str, most: int | None = None) -> DataFrame:
    """``page_end``: the next section's page (exclusive), at least one page; a span beyond ``most`` is one page."""
    following = F.lead("page").over(Window.partitionBy(key).orderBy("seq"))
    end = F.greatest(F.coalesce(following, F.col(last_page) + 1), F.col("page") + 1)
    return sections.withColumn("page_end", end if most is None else F.when(end - F.col("page") > most, F.col("page") + 1).otherwise(end))


def unique_titles(toc: DataFrame, key: str, depth: int) -> DataFrame:
    """``heading``: the title, with its parents' titles before it as long as it isn't unique within the key."""
    rows = with_parents(toc, key, depth)
    names = rows.select(key, F.col("seq").alias("parent_seq"), F.col("title").alias("parent_title"), F.col("parent_seq").alias("grand_seq"))
    out = rows.withColumn("heading", F.col("title")).withColumn("at", F.col("parent_seq"))
    for _ in range(depth - 1):
        above = names.select(key, F.col("parent_seq").alias("at"), "parent_title", "grand_seq")
        same = F.count(F.lit(1)).over(Window.partitionBy(key, "heading"))
        joined = out.withColumn("same", same).join(above, [key, "at"], "left")
        longer = (F.col("same") > 1) & F.col("parent_title").isNotNull()
        out = joined.withColumn("heading", F.when(longer, F.concat(F.lit("["), "parent_title", F.lit("] "), "heading")).otherwise(F.col("heading")))
        out = out.withColumn("at", F.when(longer, F.col("grand_seq"))).drop("same", "parent_title", "grand_seq")
    return out.drop("at")
