"""Cutting texts into pieces, and cleaning what page layouts leave behind.

Operators take and return DataFrames; a null text gives no pieces where a function doesn't say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def blocks(text: Column, step: int) -> Column:
    """A text as an array of ``step`` characters each, the last one shorter; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))


def _windows(text: Column, size: int, step: int) -> Column:
    """Windows of ``size`` characters every ``step``: each block with the start of the next ones. The text is cut once;
    substrings would count from its start each."""
    over = -(-(size - step) // step)

    def of(parts: Column) -> Column:
        more = lambda i: [F.coalesce(F.get(parts, i + k), F.lit("")) for k in range(1, over + 1)]
        return F.transform(parts, lambda x, i: F.substring(F.concat(x, *more(i)), 1, size))

    return F.get(F.transform(F.array(blocks(text, step)), of), F.lit(0))


def sliding(df: DataFrame, text: str = "text", size: int = 700, step: int = 595) -> DataFrame:
    """A row per window (piece_no, piece): a window starts every ``step`` characters, the last may lie within the one
    before; an empty text is one empty piece."""
    return df.where(F.col(text).isNotNull()).select("*", F.posexplode(_windows(F.col(text), size, step)).alias("piece_no", "piece"))


def sliding_to_end(df: DataFrame, text: str = "text", size: int = 300, overlap: int = 50) -> DataFrame:
    """Windows that stop as soon as one reaches the end of the text."""
    last = F.greatest(F.ceil((F.length(text) - size) / (size - overlap)), F.lit(0)).cast("int")
    windows = F.slice(_windows(F.col(text), size, size - overlap), F.lit(1), last + 1)
    return df.where(F.col(text).isNotNull()).select("*", F.posexplode(windows).alias("piece_no", "piece"))


def packed(parts: Column, size: int, glue: str) -> Column:
    """Greedy packing of an array of strings: a group closes before a part that would take it beyond ``size``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(s: Column, x: Column) -> Column:
        fits = s["open"].isNull() | (F.length(s["open"]) + F.length(x) + len(glue) <= size)
        grown = F.when(s["open"].isNull(), x).otherwise(F.concat(s["open"], F.lit(glue), x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits, grown).otherwise(x).alias("open"))

    return F.aggregate(parts, start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def packed_lines(df: DataFrame, text: str = "text", size: int = 700) -> DataFrame:
    """Lines packed into pieces without overlap; a line longer than ``size`` is a piece of its own."""
    groups = packed(F.split(F.col(text), "\n"), size, "\n")
    return df.where(F.col(text).isNotNull()).select("*", F.posexplode(groups).alias("piece_no", "piece"))


def packed_paragraphs(df: DataFrame, text: str = "text", size: int = 3000) -> DataFrame:
    """Paragraphs packed into groups; ``group_name`` numbers them only if there are several."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n{2,}"), T.without_outer_blanks), lambda x: x != "")
    df = df.where(F.col(text).isNotNull()).withColumn("__groups", packed(parts, size, "\n\n"))
    name = F.when(F.size("__groups") > 1, F.concat(F.lit(" ("), F.col("piece_no") + 1, F.lit(")"))).otherwise("")
    return df.select("*", F.posexplode("__groups").alias("piece_no", "piece")).withColumn("group_name", name).drop("__groups")


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, line_no, line): the lines of each text."""
    return df.where(F.col(text).isNotNull()).select("*", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def without_contained(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows whose text isn't contained in the next row's."""
    following = F.lead(text).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__next", following).where(F.col("__next").isNull() | ~F.contains(F.col("__next"), F.col(text))).drop("__next")


def segmented(df: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """``segment``: how many headings began up to each row."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(heading, 1).otherwise(0)).over(running))


def disambiguated(df: DataFrame, key: str, order: str, title: str) -> DataFrame:
    """``title_no``: " (n)" from the second row of a title on, else empty."""
    nth = F.row_number().over(Window.partitionBy(key, title).orderBy(order))
    return df.withColumn("title_no", F.when(nth > 1, F.concat(F.lit(" ("), nth, F.lit(")"))).otherwise(""))


def running_labels(df: DataFrame, page: str, line: str, share: float = 0.15) -> DataFrame:
    """(line, pages): lines that stand on at least a share of all pages; counts are pre-aggregated."""
    pages = df.agg(F.count_distinct(page).alias("all_pages"))
    return df.groupBy(line).agg(F.count_distinct(page).alias("pages")).join(F.broadcast(pages)).where(F.col("pages") >= F.col("all_pages") * share).drop("all_pages")


def without_furniture(lines_column: Column, most: int = 4) -> Column:
    """An array of lines without up to ``most`` leading lines that are blank, digits only, or titles of chapters."""
    bare = lambda x: F.trim(x).rlike(r"^\d*$") | T.chapter_of(F.trim(x)).isNotNull()
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("going"))
    head = F.slice(lines_column, 1, most)
    drop = F.aggregate(head, start, lambda s, x: F.struct((s["n"] + F.when(s["going"] & bare(x), 1).otherwise(0)).alias("n"), (s["going"] & bare(x)).alias("going")), lambda s: s["n"])
    return F.slice(lines_column, drop + 1, F.greatest(F.size(lines_column) - drop, F.lit(0)))


def split_with_carry(parts: Column, size: int = 1200, carry: int = 100) -> Column:
    """Lines packed up to ``size``; a new piece begins with the last lines of the one before, up to ``carry``
    characters in all."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def tail(lines_: Column) -> Column:
        seed = F.struct(none.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("going"))

        def take(s: Column, x: Column) -> Column:
            fits = s["going"] & (s["n"] + F.length(x) <= carry)
            return F.struct(F.when(fits, F.concat(F.array(x), s["kept"])).otherwise(s["kept"]).alias("kept"), (s["n"] + F.when(fits, F.length(x) + 1).otherwise(0)).alias("n"), fits.alias("going"))

        return F.aggregate(F.reverse(lines_), seed, take, lambda s: s["kept"])

    def size_of(lines_: Column) -> Column:
        return F.aggregate(lines_, F.lit(0), lambda n, x: n + F.length(x) + 1)

    def add(s: Column, x: Column) -> Column:
        full = (F.size(s["open"]) > 0) & (s["n"] + F.length(x) + 1 > size)
        kept = tail(s["open"])
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"]).alias("done"),
            F.when(full, F.concat(kept, F.array(x))).otherwise(F.concat(s["open"], F.array(x))).alias("open"),
            F.when(full, size_of(kept) + F.length(x) + 1).otherwise(s["n"] + F.length(x) + 1).alias("n"),
        )

    return F.aggregate(parts, start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"]))


def with_breadcrumbs(df: DataFrame, ancestors: str, title: str, piece: str) -> DataFrame:
    """``piece`` with the path to its section before it."""
    path = F.array_join(F.concat(F.col(ancestors), F.array(F.col(title))), " > ")
    return df.withColumn(piece, F.concat(F.lit("["), path, F.lit("] "), F.col(piece)))
