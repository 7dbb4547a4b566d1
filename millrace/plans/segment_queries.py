"""Sections of documents: expansion, segmentation by titles, merging of short pieces, recovery of chapters.

A document's lines stand for the lines of a manual, eight to a page; headers, step numbers and labels of tables that the
rules are about are built into them by line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunking, sections
from millrace.plans.registry import query, table
from millrace.plans.structure_queries import TOC

LINES = """
    WITH raw AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
        FROM documents WHERE text IS NOT NULL
    )
"""


def _lines(spark, sf_dir):
    return chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("line_no").alias("seq"), "line")


@query(TOC + """
    , x AS (
        SELECT p.*, l.line, sum(length(l.line) + 1) OVER w AS read, sum(length(l.line) + 1) OVER w - length(l.line) - 1 AS before
        FROM p JOIN l ON l.doc_id = p.doc_id AND l.n = p.seq WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.seq)
    ), u AS (
        SELECT *, CASE level WHEN 1 THEN min(CASE WHEN level <= 1 THEN seq END) OVER f WHEN 2 THEN min(CASE WHEN level <= 2 THEN seq END) OVER f
            ELSE min(seq) OVER f END AS until,
            CASE level WHEN 1 THEN min(CASE WHEN level <= 1 THEN before END) OVER f WHEN 2 THEN min(CASE WHEN level <= 2 THEN before END) OVER f
            ELSE min(before) OVER f END AS stop, max(read) OVER (PARTITION BY doc_id) AS whole
        FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    ), s AS (SELECT *, coalesce(stop, whole) - before - 1 AS chars FROM u),
    kept AS (
        SELECT s.* FROM s LEFT JOIN s a ON a.doc_id = s.doc_id AND a.seq = s.parent_seq
        WHERE (s.chars <= 600 OR s.leaf) AND (a.chars IS NULL OR a.chars > 600)
    )
    SELECT k.doc_id, k.seq, 0 AS piece_no, string_agg(l.line, chr(10) ORDER BY l.n) AS piece
    FROM kept k JOIN l ON l.doc_id = k.doc_id AND l.n >= k.seq AND (k.until IS NULL OR l.n < k.until)
    GROUP BY k.doc_id, k.seq HAVING trim(string_agg(l.line, chr(10) ORDER BY l.n)) <> '' OR length(string_agg(l.line, chr(10) ORDER BY l.n)) <= 600
""")
def chk5_expanded(spark, sf_dir):
    """Sections beyond 600 characters (the documents are shorter than manuals) give way to those below them."""
    size = F.length("line")
    rows = _lines(spark, sf_dir).withColumn("level", F.when(size < 30, 1).when(size < 90, 2).otherwise(3))
    return sections.expanded(rows, "doc_id", 3, 600)


@query(LINES + """
    , b AS (
        SELECT doc_id, n, n // 8 AS page, CASE WHEN n % 9 = 4 THEN '1' WHEN n % 13 = 6 THEN '제품 규격' WHEN n % 9 = 2 THEN substring(raw, 1, 10)
            WHEN n % 10 = 5 THEN lag(raw, 5) OVER (PARTITION BY doc_id ORDER BY n) ELSE raw END AS line FROM raw
    ), s AS (SELECT *, trim(line) AS bare, list(trim(line)) OVER (PARTITION BY doc_id, page ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM b),
    t AS (SELECT doc_id, unnest([page, page + 1]) AS page, bare, n, CASE WHEN n % 10 = 0 THEN 2 ELSE 3 END AS level FROM s WHERE n % 10 IN (0, 3, 7)),
    tl AS (SELECT doc_id, page, bare, arg_max(level, n) AS level FROM t GROUP BY ALL),
    j AS (SELECT s.*, tl.level FROM s LEFT JOIN tl USING (doc_id, page, bare)),
    r AS (
        SELECT *, coalesce(level = 2 AND bare = last_value(CASE WHEN level = 2 THEN bare END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM j
    ), k AS (
        SELECT *, CASE WHEN again THEN 'hidden' WHEN level = 2 THEN 'group' WHEN level = 3 THEN 'heading'
            WHEN bare IN ('최대 세탁 용량', '최대 건조 용량', '제품 규격', '제품 규격 정보') THEN 'spec'
            WHEN length(bare) BETWEEN 1 AND 20 AND NOT regexp_matches(bare, '^[0-9•~*-]') AND NOT regexp_matches(bare, '(요\\.|다\\.|니다|세요|:|\\?)$')
                AND list_contains(ahead, '1') THEN 'hidden' END AS kind FROM r
    ), w AS (
        SELECT *, max(CASE WHEN kind = 'group' THEN n END) OVER o AS g, max(CASE WHEN kind IN ('group', 'heading') THEN n END) OVER o AS h,
            max(CASE WHEN kind IS NOT NULL THEN n END) OVER o AS x FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY n)
    ), c AS (
        SELECT w.doc_id, coalesce(w.x, -1) AS seq, w.n, w.line, concat_ws(' > ', kg.bare, CASE WHEN kh.kind = 'heading' THEN kh.bare END,
            CASE kx.kind WHEN 'spec' THEN '제품 규격' WHEN 'hidden' THEN kx.bare END) AS heading
        FROM w LEFT JOIN k kg ON kg.doc_id = w.doc_id AND kg.n = w.g LEFT JOIN k kh ON kh.doc_id = w.doc_id AND kh.n = w.h
            LEFT JOIN k kx ON kx.doc_id = w.doc_id AND kx.n = w.x
        WHERE w.kind IS NULL OR w.kind = 'spec'
    )
    SELECT doc_id, seq, heading, trim(string_agg(line, chr(10) ORDER BY n), chr(10) || ' ') AS body FROM c GROUP BY doc_id, seq, heading
    HAVING length(trim(string_agg(line, chr(10) ORDER BY n), chr(10) || ' ')) > 30
""")
def chk12_title_segments(spark, sf_dir):
    n, line = F.col("seq"), F.col("line")
    # the group's title again, five lines on
    again = _lines(spark, sf_dir).where(n % 10 == 0).select("doc_id", (n + 5).alias("seq"), line.alias("title"))
    built = F.when(n % 9 == 4, "1").when(n % 13 == 6, "제품 규격").when(n % 9 == 2, F.substring(line, 1, 10)).when(n % 10 == 5, F.col("title")).otherwise(line)
    rows = _lines(spark, sf_dir).join(again, ["doc_id", "seq"], "left").select("doc_id", F.floor(n / 8).cast("int").alias("page"), "seq", built.alias("line"))
    titles = rows.where((n % 10).isin(0, 3, 7)).select("doc_id", "page", "seq", F.when(n % 10 == 0, 2).otherwise(3).alias("level"), F.trim("line").alias("title"))
    return sections.segmented_by_titles(rows, titles, "doc_id")


@query(LINES + """
    , t AS (SELECT doc_id, n, n // 10 AS section, substring(raw, 1, 6) AS subsection, raw AS body FROM raw),
    m AS (SELECT *, length(body) >= 120 OR coalesce(lag(section) OVER w <> section, true) AS alone FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    g AS (SELECT *, sum(alone::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM m)
    SELECT doc_id, CAST(min(n) AS INT) AS seq, CAST(min(section) AS INT) AS section, arg_min(subsection, n) AS subsection,
        string_agg(CASE WHEN alone OR subsection = '' THEN body ELSE '[' || subsection || '] ' || body END, chr(10) ORDER BY n) AS body
    FROM g GROUP BY doc_id, g
""")
def chk16_merged_pieces(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", "seq", F.floor(F.col("seq") / 10).cast("int").alias("section"), F.substring("line", 1, 6).alias("subsection"), F.col("line").alias("body"))
    return sections.short_pieces_merged(rows, "doc_id")


@query(LINES + r"""
    , t AS (SELECT doc_id, n, CASE n % 3 WHEN 0 THEN trim(raw) || ' (' || n || ')' ELSE trim(raw) END AS title, n // 8 + 1 - n % 4 AS hint FROM raw WHERE n % 5 = 1 AND trim(raw) <> ''),
    p AS (SELECT DISTINCT doc_id, page, line FROM (SELECT doc_id, n // 8 + 1 AS page, trim(raw) AS line FROM raw UNION ALL SELECT doc_id, 0, title FROM t)),
    v AS (SELECT DISTINCT doc_id, n, hint, title, unnest([title, trim(regexp_replace(title, '\s*\([^()]*\)\s*$', ''))]) AS line FROM t),
    names AS (SELECT DISTINCT doc_id, line FROM v WHERE line <> ''), many AS (SELECT doc_id, count(*) AS n_titles FROM names GROUP BY doc_id),
    printed AS (
        SELECT doc_id, page FROM p JOIN names USING (doc_id, line) JOIN many USING (doc_id) GROUP BY doc_id, page, n_titles
        HAVING count(*) >= 5 AND count(*) * 10 >= n_titles * 4
    ), met AS (
        SELECT v.doc_id, n, title, p.page, CASE WHEN p.page = hint THEN 0 WHEN p.page = hint + 1 THEN 1 ELSE 2 END AS r
        FROM v JOIN p USING (doc_id, line) ANTI JOIN printed ON printed.doc_id = v.doc_id AND printed.page = p.page
    ), f AS (SELECT doc_id, n, title, arg_min(page, (r, page)) AS page FROM met GROUP BY doc_id, n, title),
    last AS (SELECT doc_id, max(page) + 1 AS n_pages FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(n AS INT) AS seq, title, CAST(page AS INT) AS page,
        CAST(greatest(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page, n), n_pages), page + 1) AS INT) AS page_end
    FROM f JOIN last USING (doc_id)
""")
def chk15_recovered_chapters(spark, sf_dir):
    """Page 0 prints all titles; hints are up to three pages off."""
    n, page = F.col("seq"), F.floor(F.col("seq") / 8).cast("int") + 1
    rows = _lines(spark, sf_dir)
    name = F.when(n % 3 == 0, F.concat(F.trim("line"), F.lit(" ("), n, F.lit(")"))).otherwise(F.trim("line"))
    titles = rows.where((n % 5 == 1) & (F.trim("line") != "")).select("doc_id", "seq", name.alias("title"), (page - n % 4).alias("hint"))
    pages = rows.select("doc_id", page.alias("page"), "line").union(titles.select("doc_id", F.lit(0), "title"))
    return sections.recovered_chapters(titles, pages, "doc_id")


@query("SELECT vec_id, label, len(embedding) AS dims FROM embeddings")
def src9_collection_scan(spark, sf_dir):
    """All rows of a collection; paging is the scan's own splits."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims"))


@query("""
    SELECT source || '-' || doc_id AS id, source, text FROM documents
    WHERE source IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 10)
""")
def src13_model_chunks(spark, sf_dir):
    """All texts of ten sources, the largest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    largest = docs.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10).select("source")
    return docs.join(F.broadcast(largest), "source", "left_semi").select(F.concat_ws("-", "source", "doc_id").alias("id"), "source", "text")
