"""Mixing sources to target weights, with DataFrame functions only.

Nulls: a null text has size 0; a null source is a source of its own, last in order; rows without doc_id draw by their
text. An empty text has size 0, a text of any length is counted in place. Sources of size 0 get target 0. Rows that
repeat a doc_id get the same draw. An empty table gives an empty result. Extra columns, of any name, are ignored by
``mixing_plan`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

#: ASCII blanks as the size of a document counts them.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "millrace-mix"


def with_running_sums(rows: DataFrame, order: list, columns: list[str], label: str) -> DataFrame:
    """``rows`` with before_<column>: the sum of the column over all rows that come earlier in a total order.

    Rows are dealt by ranges of the order and summed within each; a table with one row for each range gives the sums of
    the ranges before. So no task holds more than a range.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), label)
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range_no").agg(*(F.sum(c).alias(f"own_{c}") for c in columns))
    sums = sums.select("range_no", *(F.coalesce(F.sum(f"own_{c}").over(earlier), F.lit(0)).alias(f"first_{c}") for c in columns))
    within = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        dealt = dealt.withColumn(f"within_{c}", F.coalesce(F.sum(c).over(within), F.lit(0)))
    found = dealt.join(sums, "range_no")
    return found.select(*rows.columns, *((F.col(f"first_{c}") + F.col(f"within_{c}")).alias(f"before_{c}") for c in columns))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources in order of code points, null last, take the weights in turn and share all words. A target stops at
    ``cap`` times its source's words, and what it leaves is shared again by weight. The limit of that process is
    min(cap * size, level * weight) for one level: in order of cap / weight the capped sources come first, so
    running sums find the level without a loop. Sources may be as many as hosts: they are dealt by ranges.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = with_running_sums(by_source, [F.col("source").asc_nulls_last()], ["one"], "mix-sources").select(
        "source",
        "source_size",
        F.col("before_one").alias("nth"),
        F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * cap).alias("cap"),
    )
    ordered = written(with_running_sums(ranked, [F.col("cap") / F.col("weight"), F.col("nth")], ["cap", "weight"], "mix-order"), "mix-ordered")
    totals = ordered.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))  # one row
    wide = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    rest = (
        ordered.withColumn("left", totals.select("total").scalar() - F.col("before_cap"))
        .withColumn("open", totals.select("weights").scalar() - F.col("before_weight"))
        .withColumn("capped", wide("cap", 19) * wide("open", 18) <= wide("left", 19) * wide("weight", 18))
    )
    # the first source that is not capped sets the level for itself and all that follow
    level = rest.where("NOT capped").agg(F.min(F.struct(F.col("cap") / F.col("weight"), "nth", "left", "open")).alias("level")).scalar()
    shared = level.getField("left") * F.col("weight") / level.getField("open")
    return rest.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def draw_key(doc_id, text):
    """What seeds a document's draw: its doc_id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def copies(rate, key):
    """floor(rate) copies, and one more with the fraction's probability by a draw seeded with the key."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), key)), 1, 13), 16, 10)
    whole = F.floor(rate)
    return (whole + F.when(draw.cast("double") / float(1 << 52) < rate - whole, 1).otherwise(0)).cast("long")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per document.

    Sums per source are pre-aggregated before they meet, so a hot source costs one row a task. The per-source
    table is written, so that the planner knows its size when it picks the join: broadcast below its threshold,
    else a shuffle join whose large partitions adaptive execution splits.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select("doc_id", "source", size.alias("size"), draw_key(F.col("doc_id"), F.col("text")).alias("key"))
    sizes = written(sizes, "mix-sizes")
    shares = written(targets(sizes, weights, cap), "mix-targets").withColumnRenamed("source", "share_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sizes.join(shares, F.col("source").eqNullSafe(F.col("share_source")))
        .withColumn("copies", copies(rate, F.col("key")))
        .drop("share_source", "key")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it; all columns stay."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sums")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = written(targets(sizes, weights, cap), "mix-targets").select(F.col("source").alias("share_source"), rate.alias("rate"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", draw_key(F.col("doc_id"), F.col("text")).alias("key"))
    taken = F.explode(F.array_repeat(F.lit(1), copies(F.col("rate"), F.col("key")).cast("int")))
    return rows.join(shares, F.col("source").eqNullSafe(F.col("share_source"))).select("row", taken).select("row.*")
