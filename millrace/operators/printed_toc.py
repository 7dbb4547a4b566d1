"""Tables of contents as they are printed on pages: entries from positioned text.

Two layouts. In blocks, lines alternate between a title and its page number; a block with one entry is a chapter, one
with more holds a chapter's parts. In columns, titles and numbers are spans of their own: numbers count if they stand in
the page's main column of numbers, a title takes the number nearest to it in height, and the titles' columns are the
levels. Columns are runs of close x positions: gaps and islands over sorted values.

Nulls: rows without text, position or page take no part. Pages without entries give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Pattern of a page number alone, distances of columns, of numbers and titles in height, and least sizes.
NUMBER, DIGITS = r"^[\p{Nd}\s]+$", r"^\p{Nd}+$"
NUMBER_GAP, TITLE_GAP, HEIGHT, LARGEST = 10, 15, 4, 1.3
LEAST_NUMBERS, LEAST_OF_LEVEL, SCANNED = 5, 3, 6


def islands(values: DataFrame, key: list[str], value: str, gap: float) -> DataFrame:
    """(*key, value, island): distinct values; a value further than ``gap`` from the one before begins a new island."""
    order = Window.partitionBy(*key).orderBy(value)
    begins = F.coalesce(F.col(value) - F.lag(value).over(order) > gap, F.lit(True))
    return values.select(*key, value).distinct().withColumn("island", F.count_if(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def reading_order(x: Column, y: Column) -> list[Column]:
    """Columns of about 50 points from left to right, each from top to bottom."""
    return [F.bround(x / 50), y]


def block_entries(lines: DataFrame, key: list[str], marked: Column | None = None) -> DataFrame:
    """(*key, page, level, title, number, x, y, nth) of blocks of lines (*key, page, block, line, x, y, text).

    A line that is no number, followed in its block by one that is, is an entry; blank lines don't count. Only the first
    ``SCANNED`` pages are read, and of these the ones of which some line has ``marked``.
    """
    rows = lines.where((F.col("page") <= SCANNED) & F.col("text").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("title", T.stripped(F.col("text"))).where("title <> ''")
    if marked is not None:
        rows = rows.withColumn("on", F.max(marked).over(Window.partitionBy(*key, "page"))).where("on").drop("on")
    following = F.lead("title").over(Window.partitionBy(*key, "page", "block").orderBy("line"))
    pairs = rows.withColumn("number", following).where(~F.col("title").rlike(DIGITS) & F.col("number").rlike(DIGITS))
    count = F.count(F.lit(1)).over(Window.partitionBy(*key, "page", "block"))
    found = pairs.withColumn("level", F.when(count == 1, 1).otherwise(2))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("page", *reading_order(F.col("x"), F.col("y")), "block", "line"))
    return found.select(*key, "page", "level", "title", F.expr("try_cast(number AS long)").alias("number"), "x", "y", nth.alias("nth"))


def column_entries(spans: DataFrame, key: list[str]) -> DataFrame:
    """(*key, page, level, title, number, x, y, nth) of spans (*key, page, span, x, y, size, text)."""
    page = [*key, "page"]
    rows = spans.where("page IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("text", T.stripped(F.col("text"))).where("text <> ''").withColumn("size", F.round("size", 1))
    titles, numbers = rows.where(~F.col("text").rlike(NUMBER)), rows.where(F.col("text").rlike(NUMBER))

    counts = titles.groupBy(*page, "size").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("first"))
    body = counts.groupBy(*page).agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    titles = titles.join(body, page).where(F.col("size") <= F.col("body") * LARGEST)

    columns = islands(numbers, page, "x", NUMBER_GAP)
    main = columns.groupBy(*page, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*page).agg(F.max_by("island", F.struct("n", -F.col("island"))).alias("island"))
    places = columns.join(main, [*page, "island"]).select(*page, F.bround("x").alias("rounded")).distinct()
    numbers = numbers.withColumn("rounded", F.bround("x")).join(places, [*page, "rounded"])
    enough = F.count(F.lit(1)).over(Window.partitionBy(*page)) >= LEAST_NUMBERS
    numbers = numbers.withColumn("enough", enough).where("enough")

    # numbers are dealt to the strip of their height and its neighbours, so that titles meet near ones by equality
    strip = F.floor(F.col("y") / HEIGHT)
    dealt = numbers.select(*page, F.col("span").alias("number_span"), F.col("y").alias("number_y"), F.col("text").alias("number"), F.explode(F.sequence(strip - 1, strip + 1)).alias("strip"))
    met = titles.withColumn("strip", strip).join(dealt, [*page, "strip"]).withColumn("off", F.abs(F.col("number_y") - F.col("y"))).where(F.col("off") <= HEIGHT)
    best = met.groupBy(*page, "span").agg(F.min(F.struct("off", "number_span", "number")).alias("best"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("text").alias("title"))
    found = best.withColumn("number", F.expr("try_cast(replace(best.number, ' ', '') AS long)")).where("number IS NOT NULL").withColumn("rounded", F.bround("x"))

    levels = islands(found, page, "rounded", TITLE_GAP).groupBy(*page, "island").agg(F.avg("rounded").alias("centre"))
    nearest = found.select(*page, "rounded").distinct().join(levels, page)  # the columns of one page
    level = nearest.groupBy(*page, "rounded").agg(F.min_by("island", F.struct(F.abs(F.col("centre") - F.col("rounded")), "island")).alias("level"))
    found = found.join(level, [*page, "rounded"]).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(*page, "level"))).where(F.col("same") >= LEAST_OF_LEVEL)
    nth = F.row_number().over(Window.partitionBy(*page).orderBy(*reading_order(F.col("x"), F.col("y")), "span"))
    return found.select(*page, F.col("level").cast("int").alias("level"), "title", "number", "x", "y", nth.alias("nth"))
