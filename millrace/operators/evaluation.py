"""Retrieval metrics, label statistics and their comparisons, over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import sign_test, wilson

RECALL_AT = (1, 3, 5, 10, 20, 35, 40, 60, 80, 100, 128)


def first_relevant(ranked: DataFrame, key: str, rank: str, relevant: Column) -> DataFrame:
    """(key, target_rank): least 0-based rank of a relevant row, null without one."""
    return ranked.groupBy(key).agg(F.min(F.when(relevant, F.col(rank))).alias("target_rank"))


def first_places(judged: DataFrame, rows: DataFrame, key: str, order: list[Column], marks: dict[str, Column]) -> DataFrame:
    """(key, *marks): for each mark the least 0-based rank of a row that meets it, null without one.

    ``judged`` holds ``rows`` with what the marks read; ``order`` ranks a key's rows, ascending, and names each row. No
    key is ranked as a whole: the first place of each mark is a minimum, its rank the number of rows before it, and both
    are summed up before they are shuffled.
    """
    place = F.struct(*order)
    firsts = judged.groupBy(key).agg(*[F.min(F.when(met, place)).alias(f"__{name}") for name, met in marks.items()]).withColumnRenamed(key, "__key")
    counted = rows.join(firsts, F.col(key).eqNullSafe(F.col("__key"))).groupBy(key)
    return counted.agg(*[F.when(F.max(f"__{name}").isNotNull(), F.count_if(place < F.col(f"__{name}"))).alias(name) for name in marks])


def recall_at(ranks: DataFrame, at: tuple[int, ...] = RECALL_AT) -> DataFrame:
    """(k, recall) over rows with target_rank; a missing rank is no hit."""
    hit = F.coalesce((F.col("target_rank") < F.col("k")).cast("int"), F.lit(0))
    return ranks.select("target_rank", F.explode(F.array(*map(F.lit, at))).alias("k")).groupBy("k").agg(F.avg(hit).alias("recall"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    """(n, mrr, precision_at_1) over rows with 0-based target_rank; missing ranks count 0."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(1.0 / (F.col("target_rank") + 1), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce((F.col("target_rank") == 0).cast("int"), F.lit(0))).alias("precision_at_1"),
    )


def prejudged(ranked: DataFrame, key: str, rank: str, relevant: Column, judged: Column) -> DataFrame:
    """(key, target_rank, unknown): a walk down the ranking stops at the first unjudged row, which makes it unknown
    unless a relevant row came before."""
    found = ranked.groupBy(key).agg(F.min(F.when(judged & relevant, F.col(rank))).alias("hit"), F.min(F.when(~judged, F.col(rank))).alias("gap"))
    return stopped_at_unjudged(found, key)


def stopped_at_unjudged(found: DataFrame, key: str) -> DataFrame:
    """(key, target_rank, unknown) of (key, hit, gap): the least ranks of relevant and of unjudged rows."""
    open_end = F.col("gap").isNotNull() & (F.col("hit").isNull() | (F.col("gap") < F.col("hit")))
    return found.select(key, F.when(~open_end, F.col("hit")).alias("target_rank"), open_end.alias("unknown"))


def topk_sweep(ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hits, wins, losses) of each k against the one before, over 0-based target_rank."""
    hit = lambda k: F.coalesce(F.col("target_rank") < k, F.lit(False))
    before = {k: b for b, k in zip((0, *ks), ks)}
    rows = [
        F.struct(F.lit(k).alias("k"), hit(k).cast("int").alias("hit"), (hit(k) & ~hit(before[k])).cast("int").alias("win"), (~hit(k) & hit(before[k])).cast("int").alias("loss"))
        for k in ks
    ]
    each = ranks.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return each.groupBy("k").agg(F.sum("hit").alias("hits"), F.sum("win").alias("wins"), F.sum("loss").alias("losses"))


def with_interval(df: DataFrame, hits: str, n: str) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(n))
    return df.withColumn("low", low).withColumn("high", high)


def paired(df: DataFrame, one: Column, two: Column, by: list[str]) -> DataFrame:
    """2 x 2 counts of two conditions, and the sign test of their differences."""
    both = df.groupBy(*by).agg(
        F.count_if(one & two).alias("both"), F.count_if(one & ~two).alias("only_one"), F.count_if(~one & two).alias("only_two"), F.count_if(~one & ~two).alias("neither")
    )
    return both.withColumn("p", F.round(sign_test(F.col("only_one"), F.col("only_two")), 9))


def multi_level(df: DataFrame, measures: list[Column], levels: list[list[str]]) -> DataFrame:
    """One pass over the input for several groupings; ``level`` names the columns that are grouped."""
    names = sorted({c for level in levels for c in level})
    view = df.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in names])
    mark = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    return view.agg(mark.alias("level"), *measures)


def quota(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """At most max(2, n // 5) rows of each group, then the first ``n`` in order."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= max(2, n // 5)).orderBy("__nth", *order).limit(n).drop("__nth")
