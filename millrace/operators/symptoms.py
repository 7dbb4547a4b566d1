"""Troubleshooting chapters as one chunk for each symptom: from text with wrapped lines, and from tables.

All three functions are windows over rows in reading order; a row's part in its chunk is a running count of the rows that
begin one, so no chunk needs a loop. Null texts and cells count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

#: Words of troubleshooting titles, lines of tables that say nothing, ends of lines that say it all.
TROUBLE_TITLES = ("문제 해결", "고장 진단", "고장 신고", "에러 메시지", "트러블")
JUNK_LINES = ("증상", "원인 및 해결책", "고장 신고 전 확인하기", "고장이 아닙니다", "간단한 확인조치", "고장신고 전에", "꼭확인하세요")
LINE_ENDS, BULLET, SYMPTOM_LENGTH = (".", "?", "!", ")"), "•", 45
SYMPTOM_END = r"(다|요)\.\)?$"
#: Fixed values of tables: headers, default labels, marks of list items, ends of symptoms.
HEADERS = (("증상", "확인/조치"), ("증상", "원인및해결책"), ("카테고리", "증상", "원인및해결책"), ("증상", "확인", "조치사항"), ("코드", "진단", "해결방법"))
CODE_HEAD, CATEGORY_HEAD, CODE_LABEL, LABEL, UNKNOWN, LEVEL_TWO = "코드", "카테고리", "점검 코드", "문제 해결", "(증상 미상)", "문제 해결하기"
DOTS, ITEMS, ENDING, LONGEST = ("•", "ꞏ", "·"), ("•", "ꞏ", "·", "-", "→"), r"(?<!세)(요|까|죠|네)\s*[!?.]?\s*(\([^()]*\))?\s*$", 60
BIG, MIDDLE, LEAST = 2.5, 0.8, 30


def _starts(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | text.startswith(mark)
    return found


def _ends(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | text.endswith(mark)
    return found


def _running(key: list[str], *order) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def resplit_by_symptom(sections: DataFrame, key: list[str]) -> DataFrame:
    """(*key, seq, part, heading, text, page) of sections (*key, seq, heading, ancestors, text, page).

    Neighbouring sections of troubleshooting chapters are one text, of which each symptom is a part, under the first
    section's number and page; titles that come again are numbered. A run without symptoms, and all other sections, stay.
    A line that isn't ended goes on in the next one, and a symptom is a short statement followed by a question.
    """
    trouble = F.exists(F.concat(F.coalesce("ancestors", F.array().cast("array<string>")), F.array("heading")), lambda x: _any_of(x, TROUBLE_TITLES))
    rows = sections.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("trouble", F.coalesce(trouble, F.lit(False)))
    order = Window.partitionBy(*key).orderBy("seq")
    begins = F.col("trouble") & ~F.coalesce(F.lag("trouble").over(order), F.lit(False))
    rows = rows.withColumn("run", F.when(F.col("trouble"), F.count_if(begins).over(_running(key, "seq"))))

    lines = rows.where("trouble").select(*key, "run", "seq", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", T.stripped(F.col("line")))
    lines = lines.where((F.length("line") > 3) & ~F.col("line").isin(*JUNK_LINES) & ~F.col("line").rlike(r"^\p{Nd}+$"))
    run = [*key, "run"]
    before = F.lag("line").over(Window.partitionBy(*run).orderBy("seq", "at"))
    lines = lines.withColumn("new", before.isNull() | _ends(before, LINE_ENDS) | F.col("line").startswith(BULLET))
    lines = lines.withColumn("logical", F.count_if("new").over(_running(run, "seq", "at")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "at", "line")))
    logical = lines.groupBy(*run, "logical").agg(F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("line"))

    following = F.lead("line").over(Window.partitionBy(*run).orderBy("logical"))
    plain = ~F.col("line").startswith(BULLET) & ~F.col("line").endswith("?") & (F.length("line") <= SYMPTOM_LENGTH) & F.col("line").rlike(SYMPTOM_END)
    marked = logical.withColumn("symptom", plain & F.coalesce(following.endswith("?"), F.lit(False)))
    marked = marked.withColumn("part", F.count_if("symptom").over(_running(run, "logical"))).where("part > 0")
    text = F.transform(F.array_sort(F.collect_list(F.struct("logical", "line"))), lambda x: x["line"])
    blocks = marked.groupBy(*run, "part").agg(text.alias("lines")).select(*run, "part", F.get("lines", F.lit(0)).alias("title"), F.array_join("lines", " ").alias("text"))
    same = Window.partitionBy(*run, "title")
    number = F.when(F.count(F.lit(1)).over(same) > 1, F.concat(F.lit(" ("), F.row_number().over(same.orderBy("part")), F.lit(")"))).otherwise("")
    blocks = blocks.withColumn("heading", F.concat("title", number))

    firsts = rows.where("trouble").groupBy(*run).agg(F.min("seq").alias("seq"), F.min_by("page", "seq").alias("page"))
    split = blocks.join(firsts, run).select(*key, "seq", "part", "heading", "text", "page")
    runs = blocks.select(*run).distinct()
    whole = rows.where("NOT trouble").unionByName(rows.where("trouble").join(runs, run, "left_anti"), allowMissingColumns=True)
    return split.unionByName(whole.select(*key, "seq", F.lit(0).cast("long").alias("part"), "heading", "text", "page"))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def _symptom_chunks(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(*key, chunk, category, symptom, body) of rows (…, category, symptom, cause) in order. A row without a cause says
    nothing; one whose symptom is empty, or printed again on the next page, goes on with the chunk before."""
    rows = rows.where("cause <> ''")
    w = Window.partitionBy(*key).orderBy(*order)
    last = F.last(F.when(F.col("symptom") != "", F.col("symptom")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    begins = first | ((F.col("symptom") != "") & ~F.col("symptom").eqNullSafe(last))
    rows = rows.withColumn("begins", begins).withColumn("chunk", F.count_if("begins").over(_running(key, *order)))
    place = F.struct(*order)
    causes = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "cause"))), lambda x: x["cause"])
    found = rows.groupBy(*key, "chunk").agg(F.min_by("category", place).alias("category"), F.min_by("symptom", place).alias("symptom"), F.array_join(causes, "\n").alias("causes"))
    found = found.withColumn("symptom", F.when(F.col("symptom") == "", UNKNOWN).otherwise(F.col("symptom")))
    return found.select(*key, "chunk", "category", "symptom", F.concat(F.lit("증상: "), "symptom", F.lit("\n"), "causes").alias("body"))


def _collapsed(cell: Column) -> Column:
    return T.stripped(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def symptom_tables(rows: DataFrame, headings: DataFrame, key: list[str]) -> DataFrame:
    """(*key, chunk, category, symptom, body) of table rows (*key, page, y, row, symptom, cause), row from 1, where y is
    the table's place on its page, and headings (*key, page, y, level, title) that stand between tables.

    The heading of level two in force, and the last one of another level after it, name the category.
    """
    both = rows.select(*key, "page", "y", F.lit(0).alias("late"), "row", "symptom", "cause", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title")).unionByName(
        headings.select(*key, "page", "y", F.lit(1).alias("late"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("string").alias("symptom"), F.lit(None).cast("string").alias("cause"), "level", "title")
    )
    w = _running(key, "page", "y", "late", "title", "row")
    two = F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(w)
    epoch = F.count_if(F.col("level") == 2).over(w)
    both = both.withColumn("two", two).withColumn("epoch", epoch)
    three = F.last(F.when((F.col("level") != 2) & F.col("level").isNotNull(), F.col("title")), ignorenulls=True).over(_running([*key, "epoch"], "page", "y", "late", "title", "row"))
    path = F.concat_ws(" > ", F.when(F.col("two") != LEVEL_TWO, F.col("two")), three)
    found = both.withColumn("category", F.when(path == "", LEVEL_TWO).otherwise(path)).where("level IS NULL")
    found = found.withColumn("symptom", _collapsed(F.col("symptom"))).withColumn("cause", T.cell_text(F.col("cause")))
    return _symptom_chunks(found, key, ["page", "y", "row"])


def _bare(cell: Column) -> Column:
    return F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\s﻿]+", "")


def sections_by_form(cells: DataFrame, lines: DataFrame, titles: DataFrame, chapters: list[str], key: list[str]) -> DataFrame:
    """(*key, form, chunk, label, symptom, body): a chapter's pages by the form that each has.

    ``cells``: table rows (*key, page, table, row, cells), row 0 being the header. Pages that hold a table with one of
    ``HEADERS`` are read as tables; all other pages as text. ``lines``: (*key, page, line, size, text); ``titles``: (*key,
    page, title) of the table of contents, valid on the pages beside theirs, too. On a page whose lines have a size between
    body and headings, these lines are the symptoms; elsewhere it is lines that end like a complaint before a list.
    """
    head = F.transform(F.slice("cells", 1, 3), _bare)
    known = F.lit(False)
    for names in HEADERS:
        wanted = F.array(*map(F.lit, names))
        known = known | (head == wanted) | (F.slice(head, 1, 2) == wanted)
    heads = cells.where("row = 0").where((F.size("cells") >= 2) & known)
    heads = heads.select(*key, "page", "table", F.get(head, F.lit(0)).alias("kind"))
    rows = cells.where("row > 0").join(heads, [*key, "page", "table"])
    plain = F.transform("cells", lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("﻿"), F.lit("")))
    own = _collapsed(F.get(plain, F.lit(0)))
    carried = F.last(F.when((F.col("kind") == CATEGORY_HEAD) & (own != ""), own), ignorenulls=True).over(_running([*key, "page", "table"], "row"))
    category = F.coalesce(carried, F.when(F.col("kind") == CODE_HEAD, CODE_LABEL).otherwise(LABEL))
    shift = F.when(F.col("kind").isin(CATEGORY_HEAD, CODE_HEAD), 1).otherwise(0)
    rows = rows.select(*key, "page", "table", "row", category.alias("category"), _collapsed(F.get(plain, shift)).alias("symptom"), T.cell_text(F.get(plain, shift + 1)).alias("cause"))
    tables = _symptom_chunks(rows, key, ["page", "table", "row"])

    page = [*key, "page"]
    text = lines.where(F.col("text").isNotNull()).join(heads.select(*page).distinct(), page, "left_anti")
    sizes = text.where(F.length(T.stripped(F.col("text"))) > 5).groupBy(*page, F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min("line").alias("first"))
    body = sizes.groupBy(*page).agg(F.max_by("s", F.struct("n", -F.col("first"))).alias("body_size"))
    order = Window.partitionBy(*page).orderBy("line")
    # a list mark alone goes before the next line; of a run of marks every second one does
    dot = F.col("text").isin(*DOTS)
    text = text.withColumn("dot", dot).withColumn("change", F.coalesce(F.lag(dot).over(order), F.lit(False)) != dot)
    text = text.withColumn("stretch", F.count_if("change").over(_running(page, "line")))
    text = text.withColumn("nth", F.row_number().over(Window.partitionBy(*page, "stretch").orderBy("line")))
    joins = F.when(F.col("dot"), F.col("nth") % 2 == 0).otherwise(F.coalesce((F.lag("nth").over(order) % 2 == 1) & F.lag("dot").over(order), F.lit(False)))
    text = text.withColumn("joins", joins).withColumn("own", F.count_if(~F.col("joins")).over(_running(page, "line")))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    text = text.groupBy(*page, "own").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.max_by("size", "line").alias("size"), F.min("line").alias("line"))

    near = titles.select(*key, F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"), F.col("title").alias("text")).distinct().withColumn("titled", F.lit(True))
    text = text.join(body, page, "left").join(near, [*page, "text"], "left").withColumn("titled", F.coalesce("titled", F.lit(False)))
    chapter = F.col("text").isin(*chapters) if chapters else F.lit(False)
    text = text.withColumn("body_size", F.coalesce("body_size", F.lit(10.0))).withColumn("chapter", chapter)
    middle = (F.round(F.col("size") - F.col("body_size"), 6) >= MIDDLE) & (F.round(F.col("size") - F.col("body_size"), 6) < BIG)
    text = text.withColumn("middle", middle).withColumn("by_size", F.max(middle & ~F.col("titled") & ~F.col("chapter")).over(Window.partitionBy(*page)))
    following = F.coalesce(F.lead("text").over(order), F.lit(""))
    complains = F.col("text").rlike(ENDING)
    looks = ~F.col("by_size") & ~_starts(F.col("text"), ITEMS) & (F.length("text") <= LONGEST) & complains & _starts(following, DOTS)
    symptom = (F.col("titled") & complains) | ((F.col("middle") | looks) & ~F.col("titled"))
    heading = ~symptom & (F.col("titled") | (F.round(F.col("size") - F.col("body_size"), 6) >= BIG))
    kind = F.when(symptom, "symptom").when(heading, "heading").otherwise("body")
    text = text.withColumn("kind", kind).where(~F.col("text").rlike(r"^\p{Nd}+$") & ~F.col("chapter"))

    whole = _running(key, "page", "line")
    text = text.withColumn("chunk", F.count_if(F.col("kind") != "body").over(whole)).withColumn("epoch", F.count_if(F.col("kind") == "heading").over(whole))
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == "body", F.struct("page", "line", "text"))))
    chunks = text.groupBy(*key, "epoch", "chunk").agg(
        F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("category_here"), F.max(F.when(F.col("kind") == "symptom", F.col("text"))).alias("symptom"), T.stripped(F.array_join(F.transform(texts, lambda x: x["text"]), "\n")).alias("body")
    )
    category = F.max("category_here").over(Window.partitionBy(*key, "epoch"))  # an epoch has one heading, its first row
    label = F.concat_ws(" > ", F.when(F.col("category") != "", F.col("category")), F.when(F.col("symptom") != "", F.col("symptom")))
    chunks = chunks.withColumn("category", category).where(F.length("body") > LEAST)
    chunks = chunks.select(*key, F.lit("text").alias("form"), "chunk", F.when(label == "", LABEL).otherwise(label).alias("label"), F.coalesce("symptom", F.lit("")).alias("symptom"), "body")
    return tables.select(*key, F.lit("table").alias("form"), "chunk", F.col("category").alias("label"), "symptom", "body").unionByName(chunks)
