"""Troubleshooting chapters over documents' lines: text re-split by symptoms, tables of symptoms, and pages by form.

Korean endings, headers and marks that the fixed patterns are about are built into the lines, by line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import symptoms
from millrace.plans.layout_queries import LINES, _lines
from millrace.plans.registry import query

TROUBLE = "(" + " OR ".join(f"contains(x, '{w}')" for w in symptoms.TROUBLE_TITLES) + ")"


@query(LINES + r"""
    , w0 AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '.{1,40}')) AS part, generate_subscripts(regexp_extract_all(line, '.{1,40}'), 1) AS k FROM l
    ), w AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS i FROM w0
    ), s AS (
        SELECT doc_id, i // 12 AS seq, '안내 ' || (i // 12) || CASE WHEN i // 12 % 5 IN (1, 2) THEN ' 문제 해결' ELSE '' END AS heading, CASE WHEN i // 12 % 7 = 3 THEN '고장 신고 전' ELSE '제품' END AS above, i // 30 + 1 AS page,
            i, CASE i % 6 WHEN 0 THEN part || '가 나요.' WHEN 1 THEN part || '인가요?' WHEN 3 THEN '• ' || part WHEN 5 THEN part || '.' ELSE part END AS line FROM w
    ), sec AS (
        SELECT doc_id, seq, any_value(heading) AS heading, any_value(above) AS above, min(page) AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY ALL
    ), t AS (SELECT *, len(list_filter([above, heading], lambda x: """ + TROUBLE + r""")) > 0 AS trouble FROM sec
    ), r AS (
        SELECT *, CASE WHEN trouble THEN count_if(trouble AND NOT coalesce(before, false)) OVER (PARTITION BY doc_id ORDER BY seq) END AS run FROM (SELECT *, lag(trouble) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM t)
    ), ln AS (
        SELECT * FROM (SELECT r.doc_id, run, r.seq, s.i, regexp_replace(s.line, '^\s+|\s+$', '', 'g') AS line FROM r JOIN s ON s.doc_id = r.doc_id AND s.seq = r.seq WHERE trouble)
        WHERE length(line) > 3 AND line NOT IN """ + repr(symptoms.JUNK_LINES) + r""" AND NOT regexp_full_match(line, '\p{Nd}+')
    ), lo AS (
        SELECT doc_id, run, logical, string_agg(line, ' ' ORDER BY i) AS line FROM (SELECT *, count_if(new) OVER (PARTITION BY doc_id, run ORDER BY i) AS logical FROM (
            SELECT *, coalesce(right(lag(line) OVER (PARTITION BY doc_id, run ORDER BY i), 1) IN ('.', '?', '!', ')'), true) OR starts_with(line, '•') AS new FROM ln)) GROUP BY ALL
    ), sy AS (
        SELECT *, count_if(symptom) OVER (PARTITION BY doc_id, run ORDER BY logical) AS part FROM (
            SELECT *, NOT starts_with(line, '•') AND NOT ends_with(line, '?') AND length(line) <= 45 AND regexp_matches(line, '(다|요)\.\)?$') AND coalesce(ends_with(lead(line) OVER (PARTITION BY doc_id, run ORDER BY logical), '?'), false) AS symptom FROM lo)
    ), b AS (
        SELECT doc_id, run, part, arg_min(line, logical) AS title, string_agg(line, ' ' ORDER BY logical) AS text FROM sy WHERE part > 0 GROUP BY ALL
    ), n AS (
        SELECT *, title || CASE WHEN count(*) OVER (PARTITION BY doc_id, run, title) > 1 THEN ' (' || row_number() OVER (PARTITION BY doc_id, run, title ORDER BY part) || ')' ELSE '' END AS heading FROM b
    )
    SELECT doc_id, seq, part::BIGINT AS part, md5(heading) AS heading_md5, md5(text) AS text_md5, page FROM n JOIN (SELECT doc_id, run, min(seq) AS seq, arg_min(page, seq) AS page FROM r WHERE trouble GROUP BY ALL) f USING (doc_id, run)
    UNION ALL SELECT doc_id, seq, 0, md5(heading), md5(text), page FROM r WHERE NOT trouble OR (doc_id, run) NOT IN (SELECT doc_id, run FROM b)
""")
def chk8_symptom_sections(spark, sf_dir):
    """Sections of wrapped lines; runs of troubleshooting ones are one text, split by symptom."""
    rows = _lines(spark, sf_dir).select("doc_id", "n", F.posexplode(F.regexp_extract_all("line", F.lit(".{1,40}"), 0)).alias("k", "part"))
    numbered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "k", "part"))).alias("w")).select("doc_id", F.posexplode("w").alias("i", "w")).select("doc_id", F.col("i").cast("long").alias("i"), "w.part")
    line = F.expr("CASE i % 6 WHEN 0 THEN concat(part, '가 나요.') WHEN 1 THEN concat(part, '인가요?') WHEN 3 THEN concat('• ', part) WHEN 5 THEN concat(part, '.') ELSE part END")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n")
    sections = numbered.groupBy("doc_id", F.expr("i DIV 12").alias("seq")).agg(texts.alias("text"), F.min(F.expr("i DIV 30 + 1")).alias("page"))
    sections = sections.withColumn("heading", F.expr("concat('안내 ', seq, CASE WHEN seq % 5 IN (1, 2) THEN ' 문제 해결' ELSE '' END)")).withColumn("ancestors", F.expr("array(CASE WHEN seq % 7 = 3 THEN '고장 신고 전' ELSE '제품' END)"))
    found = symptoms.resplit_by_symptom(sections, ["doc_id"])
    return found.select("doc_id", "seq", "part", F.md5("heading").alias("heading_md5"), F.md5("text").alias("text_md5"), "page")


def _chunks_sql(rows: str, order: str) -> str:
    """SQL of chunks by symptom from rows with category, symptom and cause."""
    return f"""
        SELECT doc_id, chunk, arg_min(category, place) AS category, CASE WHEN arg_min(symptom, place) = '' THEN '(증상 미상)' ELSE arg_min(symptom, place) END AS symptom, string_agg(cause, chr(10) ORDER BY place) AS causes FROM (
            SELECT *, count_if(begins) OVER (PARTITION BY doc_id ORDER BY place) AS chunk FROM (
                SELECT *, row_number() OVER w = 1 OR (symptom <> '' AND symptom IS DISTINCT FROM last_value(nullif(symptom, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS begins
                FROM (SELECT *, ({order}) AS place FROM {rows} WHERE cause <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY place))) GROUP BY doc_id, chunk"""


def _tidy(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g'), '\s*\n\s*', ' ', 'g'), '\s*•\s*', chr(10) || '• ', 'g'), '^\s+|\s+$', '', 'g')"


@query(LINES + r"""
    , rows AS (
        SELECT doc_id, n // 12 + 1 AS page, n // 4 % 3 * 100 + 50 AS y, n % 4 + 1 AS row, CASE WHEN n % 3 = 0 THEN ' 증상  ' || (n // 6) ELSE '' END AS symptom, CASE WHEN n % 11 = 7 THEN ' ' ELSE line || chr(10) || ' • ' || n END AS cause FROM l
    ), heads AS (
        SELECT doc_id, n // 12 + 1 AS page, n // 4 % 3 * 100 + 20 AS y, CASE WHEN n % 16 = 5 THEN 2 ELSE 3 END AS level, CASE WHEN n % 3 = 1 THEN '문제 해결하기' ELSE 'T' || n END AS title FROM l WHERE n % 8 = 5
    ), b AS (
        SELECT *, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS two, count_if(coalesce(level = 2, false)) OVER w AS epoch FROM (
            SELECT doc_id, page, y, 0 AS late, row, symptom, cause, NULL AS level, NULL AS title FROM rows UNION ALL SELECT doc_id, page, y, 1, 0, NULL, NULL, level, title FROM heads)
        WINDOW w AS (PARTITION BY doc_id ORDER BY page, y, late, title, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ), c AS (
        SELECT *, last_value(CASE WHEN level <> 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, epoch ORDER BY page, y, late, title, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS three FROM b
    ), d AS (
        SELECT doc_id, page, y, row, coalesce(nullif(concat_ws(' > ', CASE WHEN two <> '문제 해결하기' THEN two END, three), ''), '문제 해결하기') AS category,
            regexp_replace(regexp_replace(symptom, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS symptom, """ + _tidy("cause") + r""" AS cause FROM c WHERE level IS NULL
    )
    SELECT doc_id, chunk::BIGINT AS chunk, category, symptom, md5('증상: ' || symptom || chr(10) || causes) AS body_md5 FROM (""" + _chunks_sql("d", "page, y, row") + ")")
def chk13_symptom_tables(spark, sf_dir):
    """Table rows as one chunk for each symptom, under the headings in force; a symptom printed again goes on."""
    rows = _lines(spark, sf_dir)
    cells = rows.selectExpr(
        "doc_id", "n DIV 12 + 1 AS page", "n DIV 4 % 3 * 100 + 50 AS y", "n % 4 + 1 AS row", "CASE WHEN n % 3 = 0 THEN concat(' 증상  ', n DIV 6) ELSE '' END AS symptom", "CASE WHEN n % 11 = 7 THEN ' ' ELSE concat(line, '\\n • ', n) END AS cause"
    )
    heads = rows.where("n % 8 = 5").selectExpr("doc_id", "n DIV 12 + 1 AS page", "n DIV 4 % 3 * 100 + 20 AS y", "CASE WHEN n % 16 = 5 THEN 2 ELSE 3 END AS level", "CASE WHEN n % 3 = 1 THEN '문제 해결하기' ELSE concat('T', n) END AS title")
    found = symptoms.symptom_tables(cells, heads, ["doc_id"])
    return found.select("doc_id", "chunk", "category", "symptom", F.md5("body").alias("body_md5"))


CHAPTERS = ["사용하기", "안전"]
#: Header rows by page, one of them of no known kind.
HEADS = [list(h) for h in symptoms.HEADERS] + [["품목", "값"]]


@query(LINES + rf"""
    , g AS (SELECT *, n // 10 + 1 AS p FROM l
    ), ce AS (
        SELECT doc_id, p, n % 10 AS row, p % 6 AS kind, line, n, CASE WHEN n % 4 = 0 THEN '증상 ' || (n // 8) ELSE '' END AS s, line || ' • ' || n AS c FROM g WHERE p % 3 = 0 AND n % 10 > 0
    ), tp AS (SELECT DISTINCT doc_id, p FROM ce WHERE kind <> 5
    ), ta AS (
        SELECT doc_id, p, row, coalesce(CASE WHEN kind = 2 THEN last_value(nullif(CASE WHEN n % 5 = 2 THEN '갈래 ' || n ELSE '' END, '') IGNORE NULLS) OVER (PARTITION BY doc_id, p ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END,
            CASE WHEN kind = 4 THEN '점검 코드' ELSE '문제 해결' END) AS category, s AS symptom, {_tidy("c")} AS cause FROM ce WHERE kind <> 5
    ), tx AS (
        SELECT doc_id, p, n * 2 AS line, CASE WHEN n % 7 = 0 THEN 12.5 WHEN n % 7 = 3 AND p % 4 = 1 THEN 11.0 ELSE 10.0 END AS size,
            CASE WHEN n % 30 = 21 THEN '안전' WHEN n % 5 = 1 THEN line || '나요!' WHEN n % 5 = 2 THEN '• ' || line ELSE line END AS text FROM g
        UNION ALL SELECT doc_id, p, n * 2 - 1, 10.0, '•' FROM g WHERE n % 9 IN (4, 5)
    ), t0 AS (SELECT *, text IN ('•', 'ꞏ', '·') AS dot FROM tx WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM tp)
    ), bs AS (
        SELECT doc_id, p, arg_max(s, (n, -first)) AS body FROM (SELECT doc_id, p, size AS s, sum(length(text)) AS n, min(line) AS first FROM t0 WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 5 GROUP BY ALL) GROUP BY ALL
    ), t1 AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, p, stretch ORDER BY line) AS nth FROM (SELECT *, count_if(change) OVER (PARTITION BY doc_id, p ORDER BY line) AS stretch FROM (
            SELECT *, coalesce(lag(dot) OVER (PARTITION BY doc_id, p ORDER BY line), false) <> dot AS change FROM t0))
    ), t2 AS (
        SELECT *, CASE WHEN dot THEN nth % 2 = 0 ELSE coalesce(lag(nth) OVER w % 2 = 1 AND lag(dot) OVER w, false) END AS joins FROM t1 WINDOW w AS (PARTITION BY doc_id, p ORDER BY line)
    ), t3 AS (
        SELECT doc_id, p, own, string_agg(text, ' ' ORDER BY line) AS text, arg_max(size, line) AS size, min(line) AS line FROM (SELECT *, count_if(NOT joins) OVER (PARTITION BY doc_id, p ORDER BY line) AS own FROM t2) GROUP BY ALL
    ), ti AS (
        SELECT DISTINCT doc_id, p + unnest([-1, 0, 1]) AS p, line AS text FROM g WHERE n % 10 = 6
    ), t4 AS (
        SELECT t3.*, coalesce(body, 10.0) AS body, ti.text IS NOT NULL AS titled, t3.text IN {tuple(CHAPTERS)!r} AS chapter, size - coalesce(body, 10.0) >= 0.8 AND size - coalesce(body, 10.0) < 2.5 AS middle
        FROM t3 LEFT JOIN bs USING (doc_id, p) LEFT JOIN ti ON ti.doc_id = t3.doc_id AND ti.p = t3.p AND ti.text = t3.text
    ), t5 AS (
        SELECT *, bool_or(middle AND NOT titled AND NOT chapter) OVER (PARTITION BY doc_id, p) AS by_size, coalesce(lead(text) OVER (PARTITION BY doc_id, p ORDER BY line), '') AS following,
            regexp_matches(text, '(^|[^세])(요|까|죠|네)\s*[!?.]?\s*(\([^()]*\))?\s*$') AS complains FROM t4
    ), t6 AS (
        SELECT *, CASE WHEN (titled AND complains) OR ((middle OR (NOT by_size AND NOT regexp_matches(text, '^[•ꞏ·→-]') AND length(text) <= 60 AND complains AND regexp_matches(following, '^[•ꞏ·]'))) AND NOT titled) THEN 'symptom'
            WHEN titled OR size - body >= 2.5 THEN 'heading' ELSE 'body' END AS kind FROM t5
    ), t7 AS (
        SELECT *, count_if(kind <> 'body') OVER w AS chunk, count_if(kind = 'heading') OVER w AS epoch FROM t6 WHERE NOT regexp_full_match(text, '\p{{Nd}}+') AND NOT chapter WINDOW w AS (PARTITION BY doc_id ORDER BY p, line)
    ), t8 AS (
        SELECT *, max(here) OVER (PARTITION BY doc_id, epoch) AS category FROM (
            SELECT doc_id, epoch, chunk, max(CASE WHEN kind = 'heading' THEN text END) AS here, max(CASE WHEN kind = 'symptom' THEN text END) AS symptom,
                regexp_replace(coalesce(string_agg(CASE WHEN kind = 'body' THEN text END, chr(10) ORDER BY p, line), ''), '^\s+|\s+$', '', 'g') AS body FROM t7 GROUP BY ALL)
    )
    SELECT doc_id, 'table' AS form, chunk::BIGINT AS chunk, md5(category) AS label_md5, symptom, md5('증상: ' || symptom || chr(10) || causes) AS body_md5 FROM ({_chunks_sql("ta", "p, row")})
    UNION ALL SELECT doc_id, 'text', chunk::BIGINT, md5(coalesce(nullif(concat_ws(' > ', nullif(category, ''), nullif(symptom, '')), ''), '문제 해결')), coalesce(symptom, ''), md5(body) FROM t8 WHERE length(body) > 30
""")
def chk14_sections_by_form(spark, sf_dir):
    """A chapter's pages as tables, by sizes of lines or by endings of lines, as each page has it."""
    rows = _lines(spark, sf_dir).withColumn("p", F.expr("n DIV 10 + 1"))
    symptom, cause = "CASE WHEN n % 4 = 0 THEN concat('증상 ', n DIV 8) ELSE '' END", "concat(line, ' • ', n)"
    shapes = {2: f"array(CASE WHEN n % 5 = 2 THEN concat(' 갈래  ', n) ELSE ' ' END, {symptom}, {cause})", 4: f"array('', {symptom}, {cause})"}
    shape = "CASE p % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in shapes.items()) + f" ELSE array({symptom}, {cause}) END"
    body = rows.where("p % 3 = 0 AND n % 10 > 0").selectExpr("doc_id", "p AS page", "0 AS table", "n % 10 AS row", f"{shape} AS cells")
    head = F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in HEADS)), (F.col("page") % 6 + 1).cast("int"))
    heads = body.select("doc_id", "page", "table").distinct().withColumn("row", F.lit(0).cast("long")).withColumn("cells", head)
    text = rows.selectExpr(
        "doc_id", "p AS page", "n * 2 AS line", "cast(CASE WHEN n % 7 = 0 THEN 12.5 WHEN n % 7 = 3 AND p % 4 = 1 THEN 11 ELSE 10 END AS double) AS size",
        "CASE WHEN n % 30 = 21 THEN '안전' WHEN n % 5 = 1 THEN concat(line, '나요!') WHEN n % 5 = 2 THEN concat('• ', line) ELSE line END AS text",
    ).unionByName(rows.where("n % 9 IN (4, 5)").selectExpr("doc_id", "p AS page", "n * 2 - 1 AS line", "cast(10 AS double) AS size", "'•' AS text"))
    titles = rows.where("n % 10 = 6").select("doc_id", F.col("p").alias("page"), F.col("line").alias("title"))
    found = symptoms.sections_by_form(heads.unionByName(body), text, titles, CHAPTERS, ["doc_id"])
    return found.select("doc_id", "form", "chunk", F.md5("label").alias("label_md5"), "symptom", F.md5("body").alias("body_md5"))
