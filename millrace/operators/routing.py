"""Routes of questions, decided set-wise: code lookup, missing feature, vector search, none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import retrieval

#: Distances below this are evidence.
CUT_OFF = 0.9

#: Code points of a text that a reader is shown.
SNIPPET = 220


def unanswered(questions: DataFrame, *answered: DataFrame) -> DataFrame:
    """Questions that no earlier branch answered; only these need the expensive search."""
    for branch in answered:
        questions = questions.join(branch.select("query_id").distinct(), "query_id", "left_anti")
    return questions


def routed(questions: DataFrame, codes: DataFrame, absent: DataFrame, search, fill: int = 0) -> DataFrame:
    """(query_id, route, id, distance, place, used) per evidence row; questions without any have one row with null id.

    ``codes``: (query_id, id, rank) of exact hits, distance 0; ``absent``: (query_id, id) of features known to be
    missing, distance 1, always used; ``search``: questions -> (query_id, id, distance, rank), called for the rest, and
    with ``fill`` also for code questions, whose evidence it fills up to that number.
    """
    by_code = codes.select("query_id", F.lit("error_code").alias("route"), "id", F.lit(0.0).alias("distance"), "rank", F.lit(0).alias("list"))
    missing = absent.join(codes.select("query_id").distinct(), "query_id", "left_anti")
    by_feature = missing.select("query_id", F.lit("feature_absent").alias("route"), "id", F.lit(1.0).alias("distance"), F.lit(1).alias("rank"), F.lit(0).alias("list"))
    rest = unanswered(questions, codes, absent)
    found = search(rest).select("query_id", F.lit("vector").alias("route"), "id", "distance", "rank", F.lit(0).alias("list"))
    every = by_code.unionByName(by_feature).unionByName(found)
    if fill:
        more = search(questions.join(codes.select("query_id").distinct(), "query_id", "left_semi"))
        every = every.unionByName(more.select("query_id", F.lit("error_code").alias("route"), "id", "distance", "rank", F.lit(1).alias("list")))
    placed = retrieval.ranked(every, ["list", "rank", "id"], fill or None, name="place")
    used = (F.col("distance") < CUT_OFF) | (F.col("route") == "feature_absent")
    full = questions.select("query_id").join(placed.select("query_id", "route", "id", "distance", "place", used.alias("used")), "query_id", "left")
    return full.withColumn("route", F.coalesce("route", F.lit("none"))).withColumn("used", F.coalesce("used", F.lit(False)))


def gated(candidates: DataFrame, verdict: Column, near: float = 0.85, far: float = 1.25) -> DataFrame:
    """(query_id, answered): the least distance decides, and between two thresholds a verdict (null counts as no)."""
    least = candidates.groupBy("query_id").agg(F.min("distance").alias("least"), F.max(verdict.cast("int")).alias("verdict"))
    passed = F.when(F.col("least") < near, True).when(F.col("least") >= far, False).otherwise(F.coalesce(F.col("verdict") == 1, F.lit(False)))
    return least.select("query_id", "least", passed.alias("answered"))


def source_rows(evidence: DataFrame, text: str, size: int = SNIPPET) -> DataFrame:
    """Evidence as shown to a reader: a snippet, and the distance rounded half to even."""
    return evidence.withColumn("snippet", F.substring(text, 1, size)).withColumn("distance", F.bround("distance", 3))


def capped(rows: DataFrame, group: str, line: str, order: list, per_line: int, overall: int) -> DataFrame:
    """At most ``per_line`` rows of each line and ``overall`` of each group, greedily in order."""
    within = retrieval.ranked(rows.withColumn("__line", F.struct(group, line)), order, per_line, partition="__line", name="__nth").drop("__line", "__nth")
    return retrieval.ranked(within, order, overall, partition=group, name="place")


def service_turns(questions: DataFrame, codes: DataFrame, absent: DataFrame, search, chapters, most: int = 5, first: float = 0.1, step: float = 0.05) -> DataFrame:
    """(query_id, route, id, distance, place, used, structural): evidence of a whole service turn, a row for each piece.

    ``codes``: (query_id, id, rank), exact hits, answer first, at distance 0. ``absent``: (query_id, id), a feature known
    to be missing, at distance 1 and always used. All other questions are searched: ``search`` gives (query_id, id, rank),
    re-ranked, and ``chapters`` (query_id, id, rank) of chapters that the kind of question points to, which go before and
    are marked; what is left of both gets distances by place, since re-ranking keeps no scores. Questions without evidence have one row.
    """
    top = retrieval.ranked(codes.select("query_id", "id", "rank"), ["rank", "id"], most, name="place")
    by_code = top.select("query_id", F.lit("error_code").alias("route"), "id", F.lit(0.0).alias("distance"), "place", F.lit(False).alias("structural"))
    missing = absent.join(codes.select("query_id").distinct(), "query_id", "left_anti")
    by_feature = missing.select("query_id", F.lit("feature_absent").alias("route"), "id", F.lit(1.0).alias("distance"), F.lit(1).alias("place"), F.lit(False).alias("structural"))
    rest = unanswered(questions, codes, absent)
    merged = retrieval.first_wins([chapters(rest), search(rest)], most)
    found = merged.select("query_id", F.lit("vector").alias("route"), "id", (first + step * (F.col("place") - 1)).alias("distance"), "place", (F.col("list") == 0).alias("structural"))
    used = (F.col("distance") < CUT_OFF) | (F.col("route") == "feature_absent")
    every = by_code.unionByName(by_feature).unionByName(found).withColumn("used", used)
    full = questions.select("query_id").join(every, "query_id", "left")
    return full.select("query_id", F.coalesce("route", F.lit("none")).alias("route"), "id", "distance", "place", F.coalesce("used", F.lit(False)).alias("used"), F.coalesce("structural", F.lit(False)).alias("structural"))
