"""Sections of documents whose tables of contents are flat rows: expansion, segmentation, merging, recovery of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, toc

#: Labels of specification tables, and ends of lines that are sentences.
SPEC_HEADERS = ("최대 세탁 용량", "최대 건조 용량", "제품 규격", "제품 규격 정보")
SPEC_NAME = "제품 규격"
SENTENCE_ENDS = ("요.", "다.", "니다", "세요", ":", "?")
BULLETS = ("•", "-", "~", "*")


def expanded(rows: DataFrame, key: str, depth: int, size: int = 3000) -> DataFrame:
    """(key, seq, piece_no, piece): sections no longer than ``size`` whole; longer ones give way to the sections below
    them, and those without any are packed by paragraphs.

    ``rows`` has (key, seq, level, line). A section reaches to the next row of its own level or above, so it holds those
    below it and a longer one lies only within longer ones: a section stays if it fits or has none below it, and the
    section above it doesn't fit. Text before a long section's first subsection goes. Null lines count as empty.
    """
    rows = rows.select(key, "seq", "level", F.coalesce("line", F.lit("")).alias("line"))
    order = Window.partitionBy(key).orderBy("seq")
    after, so_far = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    read = F.sum(F.length("line") + 1).over(so_far)
    marked = toc.with_parents(rows, key, depth).withColumn("read", read).withColumn("before", F.col("read") - F.length("line") - 1)
    for n in range(1, depth + 1):
        first = F.min(F.when(F.col("level") <= n, F.struct("seq", "before"))).over(after)
        marked = marked.withColumn(f"next_{n}", first)
    closing = F.coalesce(*[F.when(F.col("level") == n, F.col(f"next_{n}")) for n in range(1, depth + 1)])
    whole = F.max("read").over(Window.partitionBy(key))
    sized = marked.withColumn("until", closing["seq"]).withColumn("chars", F.coalesce(closing["before"], whole) - F.col("before") - 1)
    above = sized.select(key, F.col("seq").alias("parent_seq"), F.col("chars").alias("above"))
    both = sized.join(above, [key, "parent_seq"], "left")
    stays = ((F.col("chars") <= size) | F.col("leaf")) & (F.col("above").isNull() | (F.col("above") > size))
    start = F.last(F.when(stays, F.struct("seq", "until")), ignorenulls=True).over(so_far)
    owned = both.withColumn("start", start).where(F.col("start.until").isNull() | (F.col("seq") < F.col("start.until"))).where("start IS NOT NULL")
    texts = owned.groupBy(key, F.col("start.seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), "line"))).alias("parts"))
    texts = texts.select(key, "seq", F.array_join(F.col("parts.line"), "\n").alias("text"))
    paragraphs = F.filter(F.transform(F.split("text", r"\n{2,}"), T.without_outer_blanks), lambda x: x != "")
    pieces = F.when(F.length("text") <= size, F.array("text")).otherwise(chunking.packed(paragraphs, size, "\n\n"))
    return texts.select(key, "seq", F.posexplode(pieces).alias("piece_no", "piece"))


def hidden_header(line: Column, ahead: Column) -> Column:
    """A short line that is no list item and no sentence, with a line "1" among those ``ahead``."""
    sentence = F.lit(False)
    for end in SENTENCE_ENDS:
        sentence = sentence | line.endswith(end)
    listed = F.lit(False)
    for start in BULLETS:
        listed = listed | line.startswith(start)
    return F.length(line).between(1, 20) & ~line.rlike(r"^\p{Nd}") & ~listed & ~sentence & F.array_contains(ahead, "1")


def segmented_by_titles(lines: DataFrame, titles: DataFrame, key: str, ahead: int = 4, least: int = 30) -> DataFrame:
    """(key, seq, heading, body): lines cut where a title of the table of contents stands on its page or the next one,
    at headers that it doesn't list, and at labels of specification tables. Bodies up to ``least`` characters go.

    ``lines`` has (key, page, seq, line), ``titles`` (key, page, seq, level, title) with levels 2 (groups) and 3. A
    group's title within the group is a header below it. Of equal titles of a page the last decides.
    """
    near = titles.select(key, F.explode(F.array("page", F.col("page") + 1)).alias("page"), F.col("title").alias("bare"), "seq", "level")
    level = near.groupBy(key, "page", "bare").agg(F.max_by("level", "seq").alias("level"))
    order = Window.partitionBy(key).orderBy("seq")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    following = F.collect_list("bare").over(Window.partitionBy(key, "page").orderBy("seq").rowsBetween(1, ahead))
    df = lines.withColumn("bare", bare).withColumn("ahead", following).join(level, [key, "page", "bare"], "left")
    group = F.when(F.col("level") == 2, F.col("bare"))
    df = df.withColumn("again", F.coalesce(group == F.last(group, ignorenulls=True).over(before), F.lit(False)))
    kind = (
        F.when(F.col("again"), "hidden").when(F.col("level") == 2, "group").when(F.col("level") == 3, "heading")
        .when(F.col("bare").isin(*SPEC_HEADERS), "spec").when(hidden_header(F.col("bare"), F.col("ahead")), "hidden")
    )
    df = df.withColumn("kind", kind)

    def last(*kinds: str) -> Column:
        return F.last(F.when(F.col("kind").isin(*kinds), F.struct("seq", "bare", "kind")), ignorenulls=True).over(so_far)

    df = df.withColumn("g", last("group")).withColumn("h", last("group", "heading")).withColumn("x", last("group", "heading", "spec", "hidden"))
    hidden = F.when(F.col("x.kind") == "spec", SPEC_NAME).when(F.col("x.kind") == "hidden", F.col("x.bare"))
    path = F.concat_ws(" > ", F.col("g.bare"), F.when(F.col("h.kind") == "heading", F.col("h.bare")), hidden)
    body = df.select(key, F.coalesce("x.seq", F.lit(-1)).alias("start"), path.alias("heading"), "seq", "line", "kind").where("kind IS NULL OR kind = 'spec'")
    parts = F.array_sort(F.collect_list(F.struct("seq", "line")))
    found = body.groupBy(key, F.col("start"), "heading").agg(parts.alias("parts"))
    text = F.regexp_replace(F.array_join(F.col("parts.line"), "\n"), r"^\s+|\s+$", "")
    return found.select(key, F.col("start").alias("seq"), "heading", text.alias("body")).where(F.length("body") > least)


def short_pieces_merged(pieces: DataFrame, key: str, least: int = 120) -> DataFrame:
    """(key, section, subsection, seq, body): pieces (key, seq, section, subsection, body) shorter than ``least`` go to
    the end of the piece before, if it is of the same section, with their subsection in brackets."""
    order = Window.partitionBy(key).orderBy("seq")
    alone = (F.length("body") >= least) | ~F.coalesce(F.lag("section").over(order) == F.col("section"), F.lit(False))
    grouped = pieces.withColumn("first", F.sum(F.when(alone, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("alone", alone)
    named = F.concat(F.when(F.coalesce("subsection", F.lit("")) != "", F.concat(F.lit("["), "subsection", F.lit("] "))).otherwise(""), "body")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("alone"), F.col("body")).otherwise(named).alias("part"))))
    found = grouped.groupBy(key, "first").agg(F.min("seq").alias("seq"), F.min_by("section", "seq").alias("section"), F.min_by("subsection", "seq").alias("subsection"), parts.alias("parts"))
    return found.select(key, "seq", "section", "subsection", F.array_join(F.col("parts.part"), "\n").alias("body"))


def recovered_chapters(titles: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, seq, title, page, page_end): where chapters begin, whatever page the table of contents names.

    ``titles`` has (key, seq, title, hint), ``lines`` (key, page, line). A title, or the title without its last
    parentheses, is a line of the page named, the next one or else the first that has it. Pages that print the table
    itself, with at least 5 titles and 40 % of all, don't count. Titles that stand nowhere go.
    """
    pages = lines.groupBy(key).agg((F.max("page") + 1).alias("n_pages"))
    bare = F.trim("title")
    variants = F.array_distinct(F.array(bare, F.trim(F.regexp_replace(bare, r"\s*\([^()]*\)\s*$", ""))))
    each = titles.select(key, "seq", "hint", bare.alias("title"), F.explode(variants).alias("line")).where("line <> ''")
    distinct = lines.select(key, "page", F.trim("line").alias("line")).distinct()
    names = each.select(key, "line").distinct()
    many = names.groupBy(key).agg(F.count(F.lit(1)).alias("n_titles"))
    printed = distinct.join(names, [key, "line"]).groupBy(key, "page").agg(F.count(F.lit(1)).alias("met")).join(many, key)
    printed = printed.where((F.col("met") >= 5) & (F.col("met") * 10 >= F.col("n_titles") * 4)).select(key, "page")
    met = each.join(distinct, [key, "line"]).join(printed, [key, "page"], "left_anti")
    rank = F.when(F.col("page") == F.col("hint"), 0).when(F.col("page") == F.col("hint") + 1, 1).otherwise(2)
    found = met.groupBy(key, "seq", "title").agg(F.min_by("page", F.struct(rank, "page")).alias("page"))
    following = F.lead("page").over(Window.partitionBy(key).orderBy("page", "seq"))
    end = F.greatest(F.coalesce(following, F.col("n_pages")), F.col("page") + 1)
    return found.join(pages, key).select(key, "seq", "title", "page", end.alias("page_end"))
