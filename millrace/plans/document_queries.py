"""Chunking, text functions and HTML extraction over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, figures
from millrace.plans.registry import query, table


@query("""
    SELECT doc_id, CAST(p // 595 AS INT) AS piece_no, substring(text, p + 1, 700) AS piece
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 595)) AS p FROM documents WHERE text IS NOT NULL)
""")
def chk1_sliding_chunks(spark, sf_dir):
    return chunking.sliding(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "piece_no", "piece")


@query("""
    SELECT doc_id, CAST(p // 525 AS INT) AS piece_no, md5(substring(text, p + 1, 700)) AS piece_md5
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 525)) AS p FROM documents WHERE text IS NOT NULL)
""")
def chk1b_quarter_overlap(spark, sf_dir):
    rows = chunking.sliding(table(spark, sf_dir, "documents").select("doc_id", "text"), step=525)
    return rows.select("doc_id", "piece_no", F.md5("piece").alias("piece_md5"))


@query("""
    SELECT doc_id, CAST(n AS INT) AS piece_no, substring(text, n * 250 + 1, 300) AS piece
    FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(CAST(ceil((length(text) - 300) / 250.0) AS BIGINT), 0))) AS n
          FROM documents WHERE text IS NOT NULL)
""")
def chk1c_chunks_to_end(spark, sf_dir):
    return chunking.sliding_to_end(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "piece_no", "piece")


@query("""
    WITH RECURSIVE parts AS (
        SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
    ), walk(doc_id, n, piece_no, piece) AS (
        SELECT doc_id, 1, 0, lines[1] FROM parts
        UNION ALL
        SELECT w.doc_id, n + 1,
            CASE WHEN length(piece) + length(lines[n + 1]) + 1 <= 700 THEN piece_no ELSE piece_no + 1 END,
            CASE WHEN length(piece) + length(lines[n + 1]) + 1 <= 700 THEN piece || chr(10) || lines[n + 1] ELSE lines[n + 1] END
        FROM walk w JOIN parts p ON p.doc_id = w.doc_id WHERE n < len(lines)
    )
    SELECT doc_id, piece_no, md5(arg_max(piece, n)) AS piece_md5 FROM walk GROUP BY doc_id, piece_no
""")
def chk1d_packed_lines(spark, sf_dir):
    rows = chunking.packed_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "piece_no", F.md5("piece").alias("piece_md5"))


@query(r"""
    WITH RECURSIVE parts AS (
        SELECT * FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL) WHERE len(l) > 0
    ), walk(doc_id, n, piece_no, piece) AS (
        SELECT doc_id, 1, 0, l[1] FROM parts
        UNION ALL
        SELECT w.doc_id, n + 1, CASE WHEN length(piece) + length(l[n + 1]) + 2 <= 3000 THEN piece_no ELSE piece_no + 1 END,
            CASE WHEN length(piece) + length(l[n + 1]) + 2 <= 3000 THEN piece || chr(10) || chr(10) || l[n + 1] ELSE l[n + 1] END
        FROM walk w JOIN parts p ON p.doc_id = w.doc_id WHERE n < len(l)
    ), done AS (SELECT doc_id, piece_no, arg_max(piece, n) AS piece FROM walk GROUP BY ALL)
    SELECT doc_id, CAST(piece_no AS INT) AS piece_no, CASE WHEN max(piece_no) OVER (PARTITION BY doc_id) > 0 THEN ' (' || (piece_no + 1) || ')' ELSE '' END AS group_name, md5(piece) AS piece_md5 FROM done
""")
def chk1g_packed_paragraphs(spark, sf_dir):
    rows = chunking.packed_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "piece_no", "group_name", F.md5("piece").alias("piece_md5"))


@query("""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL
    ), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM n WHERE following IS NULL OR NOT contains(following, line)
""")
def chk6_uncontained_lines(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", "line")
    return chunking.without_contained(rows, "doc_id", "line_no", "line")


@query("""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM documents WHERE text IS NOT NULL
    ), s AS (
        SELECT *, sum(CASE WHEN length(line) <= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM l
    )
    SELECT doc_id, segment::BIGINT AS segment, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s GROUP BY doc_id, segment
""")
def chk9_heading_segments(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marked = chunking.segmented(rows, "doc_id", "line_no", F.length("line") <= 40)
    return marked.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
    SELECT line, count(DISTINCT doc_id) AS pages FROM l GROUP BY line
    HAVING count(DISTINCT doc_id) >= 0.01 * (SELECT count(DISTINCT doc_id) FROM l)
""")
def chk10_running_labels(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.running_labels(rows.select("doc_id", "line"), "doc_id", "line", 0.01)


@query("""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL
    ), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) AS nth FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END AS title_no FROM n
""")
def chk8_title_numbers(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("line", "title")
    return chunking.disambiguated(rows, "doc_id", "line_no", "title").select("doc_id", "line_no", "title_no")


@query(f"""
    WITH l AS (SELECT doc_id, string_split(CASE doc_id % 3 WHEN 0 THEN '12' || chr(10) || '관리하기 - 필터' || chr(10) || text WHEN 1 THEN chr(10) || '부록' || chr(10) || '3' || chr(10) || '관리하기' || chr(10) || '4' || chr(10) || text ELSE text END, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, list_transform(lines[1:4], lambda x: regexp_matches(trim(x), '^[0-9]*$') OR len(list_filter({list(T.CHAPTERS)!r}, lambda b: trim(x) = b OR starts_with(trim(x), b || ' - '))) > 0) AS bare FROM l)
    SELECT doc_id, len(lines) - CASE WHEN len(bare) = 0 THEN 0 WHEN NOT bare[1] THEN 0 WHEN len(bare) < 2 OR NOT bare[2] THEN 1
        WHEN len(bare) < 3 OR NOT bare[3] THEN 2 WHEN len(bare) < 4 OR NOT bare[4] THEN 3 ELSE 4 END AS kept
    FROM h
""")
def chk17_furniture(spark, sf_dir):
    """Lines of a page without numbers, blank lines and chapter titles at its head, four at most."""
    text = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('12\n관리하기 - 필터\n', text) WHEN 1 THEN concat('\n부록\n3\n관리하기\n4\n', text) ELSE text END""")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split(text, "\n").alias("lines"))
    return docs.select("doc_id", F.size(chunking.without_furniture(F.col("lines"))).cast("long").alias("kept"))


@query("""
    SELECT doc_id, regexp_replace(source || '_' || lang || '_' || substring(md5(text), 1, 8), '\\s+', '_', 'g') AS chunk_id,
        regexp_replace(source || '_' || lang, '_[^_]*$', '') AS section
    FROM documents WHERE text IS NOT NULL
""")
def fn9_chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.chunk_id(F.col("source"), F.col("lang"), body=F.col("text")).alias("chunk_id"), T.section_of(F.concat_ws("_", "source", "lang")).alias("section"))


@query("""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM documents WHERE text IS NOT NULL
    ), p AS (
        SELECT doc_id, n, bare AS a, lead(bare) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM (
            SELECT *, array_to_string(list_filter(regexp_extract_all(line, '[0-9A-Za-z가-힣]+'), lambda x: NOT regexp_full_match(x, '[0-9A-Za-z]{1,2}')), '') AS bare FROM l)
    ), g AS (
        SELECT doc_id, n,
            CASE WHEN length(a) >= 4 THEN list_distinct(list_transform(range(1, length(a) - 2), lambda i: substring(a, i, 4))) ELSE [] END AS ga,
            CASE WHEN length(b) >= 4 THEN list_distinct(list_transform(range(1, length(b) - 2), lambda i: substring(b, i, 4))) ELSE [] END AS gb
        FROM p WHERE b IS NOT NULL
    )
    SELECT doc_id, round(avg(CASE WHEN len(list_intersect(ga, gb)) >= 4 AND len(list_intersect(ga, gb)) >= 0.2 * len(ga) THEN len(list_intersect(ga, gb))::DOUBLE / least(len(ga), len(gb)) ELSE 0 END), 9) AS score
    FROM g GROUP BY doc_id
""")
def fn17_gram_scores(spark, sf_dir):
    """Shared grams of neighbouring lines, lone short tokens aside, at least a fifth of the first line's."""
    plain = F.array_join(F.transform(F.split("text", "\n"), T.gram_text), "\n")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", plain.alias("text"))
    return figures.line_scores(docs, cover=0.2).select("doc_id", F.round("score", 9).alias("score"))


@query(r"""
    WITH b AS (SELECT doc_id, regexp_replace('[' || source || '] ' || ['제품 사용', '이때 필터 청소', 'ab 가 세탁 하기', ''][doc_id % 4 + 1] || ' ' || text, '^\[[^\]]*\]\s*', '') AS body FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
    w AS (SELECT doc_id, regexp_extract_all(body, '[가-힣]{2,}') AS words FROM b)
    SELECT doc_id, coalesce(list_filter(words, lambda x: x NOT IN ('제품', '사용', '이때', '경우', '때문', '그림', '참고', '확인'))[1], words[1]) AS keyword FROM w
""")
def fn31_keywords(spark, sf_dir):
    """The first Hangul word that says something, else the first one; words are built in before the texts."""
    before = F.element_at(F.array(*map(F.lit, ("제품 사용", "이때 필터 청소", "ab 가 세탁 하기", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return docs.select("doc_id", T.first_keyword(F.concat(F.lit("["), "source", F.lit("] "), before, F.lit(" "), "text")).alias("keyword"))


@query("""
    SELECT doc_id, CASE WHEN contains(upper(text), 'IDIOT') THEN 'IDIOT' WHEN contains(upper(text), 'ERROR') THEN 'ERROR'
        WHEN contains(upper(text), 'TOKEN') THEN 'TOKEN' ELSE 'GENERAL' END AS label
    FROM documents WHERE text IS NOT NULL
""")
def fn38_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.label_from(F.col("text"), ("IDIOT", "ERROR", "TOKEN"), "GENERAL").alias("label"))


@query(r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links,
        len(regexp_extract_all(html, '<img [^>]*>')) AS images, regexp_extract(url, '^https?://([^/]+)', 1) AS host
    FROM pages
""")
def src10_html_fields(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = lambda p, g: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(g))).cast("long")
    return pages.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        found('<a [^>]*href="([^"]*)"', 1).alias("links"),
        found("<img [^>]*>", 0).alias("images"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


@query("""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL
    ), lg AS (
        SELECT DISTINCT doc_id, line_no, substring(lower(line), i, 4) AS gram
        FROM (SELECT *, unnest(range(1, length(line) - 2)) AS i FROM l WHERE length(line) >= 4)
    ), b AS (
        SELECT item_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS label,
            generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) - 1 AS label_no
        FROM benchmark WHERE text IS NOT NULL
    ), bg AS (
        SELECT DISTINCT item_id, label_no, substring(lower(label), i, 4) AS gram
        FROM (SELECT *, unnest(range(1, length(label) - 2)) AS i FROM b WHERE length(label) >= 4)
    ), ls AS (SELECT doc_id, line_no, count(*) AS n FROM lg GROUP BY ALL), bs AS (SELECT item_id, label_no, count(*) AS n FROM bg GROUP BY ALL),
    s AS (SELECT item_id, label_no, doc_id, line_no, count(*) AS shared FROM lg JOIN bg USING (gram) GROUP BY ALL HAVING count(*) >= 4)
    SELECT item_id, CAST(label_no AS INT) AS label_no, doc_id, CAST(line_no AS INT) AS line_no, round(shared::DOUBLE / least(ls.n, bs.n), 9) AS score
    FROM s JOIN ls USING (doc_id, line_no) JOIN bs USING (item_id, label_no) WHERE shared::DOUBLE / least(ls.n, bs.n) >= 0.8
""")
def jn16_label_lines(spark, sf_dir):
    """Labels (all lines and sentences of benchmark items) against lines by shared grams."""
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", F.lower("line").alias("text"))
    parts = F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("label_no", "label")
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", parts).select("item_id", "label_no", F.lower("label").alias("text"))
    return figures.gram_matches(items, rows, ["item_id", "label_no"], ["doc_id", "line_no"], 0.8).drop("shared", "n_label", "n_line")
