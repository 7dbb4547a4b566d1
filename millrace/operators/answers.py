"""Post-processing of generated answers: first sentences, warnings, citations, event order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = r"(?s)^(.{0,79}?(?:[.!?。]\s*|\n)|.{80}|.*$)"


def first_sentence(text: Column) -> Column:
    """What a reader's stream holds back: up to a sentence end or line end, at most 80 characters."""
    return F.regexp_extract(text, FIRST, 1)


def with_warning(text: Column, due: Column, phrase: str, warning: str) -> Column:
    """The answer with a warning before it where one is due; where none is, a first sentence about safety goes."""
    first = first_sentence(text)
    rest = F.substring(text, F.length(first) + 1, F.length(text))
    return F.when(due, F.concat(F.lit(warning + "\n"), text)).when(first.rlike(phrase), rest).otherwise(text)


def citation(pages: Column) -> Column:
    """Sorted distinct pages as one text, empty without pages."""
    found = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    return F.when(F.size(found) > 0, F.concat(F.lit("(p. "), F.array_join(F.transform(found, lambda p: p.cast("string")), ", "), F.lit(")"))).otherwise("")


def out_of_order(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events (message_id, seq, type) that come after a type that should follow them."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))
    so_far = F.max(place).over(Window.partitionBy("message_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("__so_far", so_far).where(F.col("__so_far") > place).drop("__so_far")


def judged(rows: DataFrame, evidence: str, label: str = "label", quote: str = "quote") -> DataFrame:
    """Labels after a check of their quotes: a decline called false without a quote from the evidence is genuine."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\"'“”‘’]", ""), r"\s+", " "))
    said = F.trim(plain(F.col(quote)))
    unproved = said.isin("", "none", "없음") | ~F.contains(plain(F.col(evidence)), said)
    return rows.withColumn(label, F.when((F.col(label) == "FALSE_DECLINE") & unproved, "GENUINE_NO_ANSWER").otherwise(F.col(label)))
