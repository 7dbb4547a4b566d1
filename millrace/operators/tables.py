"""Keyed tables: upserts, first or last wins, incremental sync, resume, catalogue joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.stored import stored


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` that ``new`` doesn't replace, and all of ``new``."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in order (insert or ignore); descending orders give insert or replace."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def sync_plan(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, action): ids to delete and ids to add."""
    gone = existing.select(key).join(wanted.select(key), key, "left_anti").select(key, F.lit("delete").alias("action"))
    new = wanted.select(key).join(existing.select(key), key, "left_anti").select(key, F.lit("add").alias("action"))
    return gone.unionByName(new)


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def best_match(rows: DataFrame, patterns: DataFrame, condition: Column, key: str, order: list) -> DataFrame:
    """For each row the first pattern in order that matches. Patterns are a dimension: the planner broadcasts them if
    their size is below its threshold."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.join(patterns, condition).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def last_messages(messages: DataFrame, conversation: str, turn: str, text: str, n: int = 8, size: int = 800) -> DataFrame:
    """The last ``n`` messages of each conversation, texts cut to ``size``."""
    nth = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(turn).desc()))
    return messages.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth").withColumn(text, F.substring(text, 1, size))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``place``: a row's number within its key, from 0, in a total order.

    Rows are dealt by ranges of key and order and counted within each; the ranges of a key, a row each, give what comes
    before. So a key with a third of all rows is no single task's.
    """
    dealt = stored(rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order)) - 1
    met = dealt.withColumn("__within", within).join(counts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    return met.select(*rows.columns, (F.col("__before") + F.col("__within")).alias("place"))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """(text, part): pairs of distinct texts and parts of which the text holds the part.

    A text's substrings of the lengths that parts have meet the parts by equality, so that no text meets all of them.
    """
    whole, wanted = texts.select(text).where(F.col(text).isNotNull()).distinct(), parts.select(part).where(F.length(part) > 0).distinct()
    sizes = wanted.agg(F.collect_set(F.length(part)).alias("sizes"))  # one row
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))
    fits = F.filter("__sizes", lambda n: n <= F.length(text))
    pieces = whole.withColumn("__sizes", sizes.select("sizes").scalar()).select(text, F.explode(F.array_distinct(F.flatten(F.transform(fits, cut)))).alias(part))
    return pieces.join(wanted, part)
