"""A service turn end to end: exact codes, features of the model, chapters that a kind of question points to, vectors.

Every twentieth embedding is a question about the part of its number; the part gives brand, category and model, and the
words of the question. Chunks are embeddings with a section's title; a question's scope is its label. No branch is decided
by an id: codes are read from the text and looked up, features by patterns, chapters by titles and by what is asked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval, routing
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import VECTORS, _vectors
from millrace.plans.scalar_queries import PANEL, TROUBLE
from millrace.plans.service_queries import _entries

#: Titles of chapters for troubles and for panels.
TROUBLE_TITLE, PANEL_TITLE = "고장 신고 전 확인하기", "패널 사용하기"
TEXT = """CASE p_size % 5 WHEN 0 THEN concat('shows E', p_size % 45, ' today') WHEN 1 THEN '에러 코드 어디서 확인하나요' WHEN 2 THEN concat('does it have ', p_type)
    WHEN 3 THEN '온도 설정 방법' ELSE concat('how about ', p_name) END"""
TITLE = f"CASE label % 3 + vec_id % 5 WHEN 2 THEN '{TROUBLE_TITLE}' WHEN 3 THEN '{PANEL_TITLE}' ELSE '사용하기' END"

TURNS = VECTORS + f""",
    qs AS (SELECT query_id, label, p_brand AS brand, p_type AS category, p_name AS model, {TEXT} AS text FROM q LEFT JOIN part ON p_partkey = query_id),
    ch AS (SELECT vec_id AS id, label, {TITLE} AS title FROM embeddings),
    co AS (SELECT query_id, brand, category, regexp_extract(text, '^shows (E[0-9]+) today$', 1) AS code FROM qs WHERE regexp_full_match(text, 'shows E[0-9]+ today')),
    cv AS (SELECT DISTINCT query_id, brand, category, unnest(list_concat([code], list_transform(range(1, length(code) + 1), lambda i: substring(code, 1, i - 1) || translate(substring(code, i, 1), 'O0I1S5B8', '0O1I5S8B') || substring(code, i + 1)))) AS variant
        FROM (SELECT query_id, brand, category, regexp_replace(code, '^E0+([0-9])', 'E\\1') AS code FROM co)),
    hit AS (SELECT query_id, entry_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY kind = 'primary' DESC, entry_id) AS rank FROM (
        SELECT DISTINCT cv.query_id, p_partkey AS entry_id, CASE WHEN p_partkey % 3 = 0 THEN 'alias' ELSE 'primary' END AS kind FROM cv JOIN part ON p_brand = brand AND p_type = category AND 'E' || (p_size % 45) = variant)),
    ab AS (SELECT query_id FROM (SELECT query_id, arg_min(p_size % 2, (regexp_replace(p_name, '[aeiou]', '*', 'g'), p_size % 2)) AS has FROM qs JOIN part ON p_brand = brand AND p_type = category AND model LIKE replace(regexp_replace(p_name, '[aeiou]', '*', 'g'), '*', '_')
        WHERE starts_with(text, 'does it have ') GROUP BY query_id) WHERE has = 0 AND query_id NOT IN (SELECT query_id FROM hit)),
    rest AS (SELECT * FROM qs WHERE query_id NOT IN (SELECT query_id FROM hit) AND query_id NOT IN (SELECT query_id FROM ab)),
    st AS (SELECT near.query_id, near.id, row_number() OVER (PARTITION BY near.query_id, title ORDER BY near.rank) AS nth, title FROM near JOIN rest USING (query_id) JOIN ch USING (id)
        WHERE (title = '{TROUBLE_TITLE}' AND regexp_matches(text, '{TROUBLE}')) OR (title = '{PANEL_TITLE}' AND regexp_matches(text, '{PANEL}'))),
    vc AS (SELECT query_id, list(id ORDER BY rank) AS held FROM near JOIN rest USING (query_id) WHERE rank <= 40 GROUP BY query_id),
    pk AS (SELECT query_id, held[i + 1] AS id, place FROM (SELECT query_id, held, unnest(o) AS i, generate_subscripts(o, 1) AS place FROM (
        SELECT query_id, held, CASE WHEN len(held) > 5 AND length(model) % 2 = 0 THEN list_filter([3, 1, 7, 2, 0], lambda x: x < len(held)) ELSE range(0, least(5, len(held)))::INT[] END AS o FROM vc JOIN rest USING (query_id)))),
    mg AS (SELECT query_id, id, min(seen) AS seen FROM (SELECT query_id, id, (0, title = '{PANEL_TITLE}', nth) AS seen FROM st WHERE nth <= 5 UNION ALL SELECT query_id, id, (1, false, place) FROM pk) GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, id) AS place FROM mg QUALIFY place <= 5),
    ev AS (SELECT query_id, 'error_code' AS route, id, 0.0 AS distance, rank AS place, true AS used, false AS structural FROM hit WHERE rank <= 5
        UNION ALL SELECT query_id, 'feature_absent', query_id, 1.0, 1, true, false FROM ab
        UNION ALL SELECT query_id, 'vector', id, 0.1 + 0.05 * (place - 1), place, true, seen[1] = 0 FROM pl)
    SELECT query_id, coalesce(route, 'none') AS route, id, round(distance::DOUBLE, 6) AS distance, place::BIGINT AS place, coalesce(used, false) AS used, coalesce(structural, false) AS structural FROM q LEFT JOIN ev USING (query_id)
"""


@query(TURNS)
def rte1_service_turns(spark, sf_dir):
    """Codes, then features, then chapters and vectors as one pass over all questions."""
    vectors, chunks = _vectors(spark, sf_dir)
    parts = table(spark, sf_dir, "part")
    asked = parts.selectExpr("p_partkey AS query_id", "p_brand AS brand", "p_type AS category", "p_name AS model", f"{TEXT} AS text")
    questions = vectors.join(asked, "query_id", "left")
    titles = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", f"{TITLE} AS title")

    codes = questions.select("query_id", "brand", "category", F.explode(T.codes_in(F.col("text"))).alias("code"))
    variants = codes.select("query_id", "brand", "category", F.explode(T.code_variants(F.col("code"))).alias("code_norm")).distinct()
    # a turn shows five hits, so no more of a code's entries are looked at
    code, order = ["brand", "category", "code_norm"], lambda c: [(F.col("kind") == "primary").desc(), c]
    held = _entries(spark, sf_dir).select(*code, "entry_id", "kind").distinct().withColumn("code", F.struct(*code))
    first_entries = retrieval.ranked(held, order("entry_id"), 5, partition="code").select(*code, F.col("entry_id").alias("id"), "kind")
    entries = variants.join(first_entries, code).select("query_id", "id", "kind").distinct()
    hits = retrieval.ranked(entries, order("id"), 5).select("query_id", "id", "rank")

    known = parts.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.regexp_replace("p_name", "[aeiou]", "*").alias("pattern"), (F.col("p_size") % 2).alias("has"))
    known = known.groupBy("brand", "category", "pattern").agg(F.min("has").alias("has"))
    wanted = questions.where(F.col("text").startswith("does it have ")).join(known, ["brand", "category"]).where(T.matches_pattern(F.col("model"), F.col("pattern")))
    first = wanted.groupBy("query_id").agg(F.min(F.struct("pattern", "has")).alias("first"))
    absent = first.where("first.has = 0").select("query_id", F.col("query_id").alias("id"))

    def chapters(rest):
        """Of each kind that is asked for, the five nearest chunks of its chapter; troubles before panels."""
        kinds = ((TROUBLE, TROUBLE_TITLE), (PANEL, PANEL_TITLE))
        lists = []
        for n, (pattern, title) in enumerate(kinds):
            held = chunks.join(titles.where(F.col("title") == title), "id")
            found = retrieval.nearest(rest.where(F.col("text").rlike(pattern)), held, "label", 5)
            lists.append(found.select("query_id", "id", (F.col("rank") + n * 5).alias("rank")))
        return lists[0].unionByName(lists[1])

    def search(rest):
        near = retrieval.nearest(rest, chunks, "label", 40)
        replies = rest.select("query_id", F.when(F.length("model") % 2 == 0, "3, 1 and 7, then 2, 0").alias("reply"))
        return retrieval.reranked(near, replies, 40, 5).select("query_id", "id", F.col("place").alias("rank"))

    found = routing.service_turns(questions, hits, absent, search, chapters)
    return found.select("query_id", "route", "id", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"), "used", "structural")
