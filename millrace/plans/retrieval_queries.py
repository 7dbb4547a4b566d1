"""Vector retrieval, fusion, catalogue joins, keyed tables and routing over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import numbers as N
from millrace.functions import text as T
from millrace.operators import answers, retrieval, tables
from millrace.operators.stored import stored
from millrace.plans.registry import query, table

DISTANCE = "list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
VECTORS = """
    WITH c AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    q AS (SELECT id AS query_id, label, e FROM c WHERE id % 20 = 0),
    near AS (
        SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
        FROM (SELECT q.query_id, c.id, """ + DISTANCE + """ AS distance FROM q JOIN c USING (label))
    )
"""


def _vectors(spark, sf_dir):
    """Search queries are every row whose id is divisible by 20, against all rows."""
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    queries = chunks.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label", F.col("vector").alias("query_vector"))
    return queries, chunks


@query(VECTORS + "SELECT query_id, id, round(distance, 6) AS distance, rank FROM near WHERE rank <= 40")
def vec1_scoped_neighbours(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    return retrieval.nearest(queries, chunks, "label", 40).withColumn("distance", F.round("distance", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(VECTORS + """, best AS (
        SELECT *, row_number() OVER (PARTITION BY query_id, id % 7 ORDER BY rank) AS nth FROM near WHERE rank <= 20
    )
    SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM best WHERE nth = 1
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5
""")
def top3_diverse_sections(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = retrieval.nearest(queries, chunks, "label", 20).withColumn("section", F.col("id") % 7)
    return retrieval.diverse(near, "section", 5).selectExpr("query_id", "id", "cast(rank AS long) AS rank", "cast(place AS long) AS place")


def question_hits(queries, chunks):
    """(query_id, parent_id, rank): hits among expected questions lead to the chunk that each belongs to, once, at its
    best rank. A chunk has eight questions or four, by its kind."""
    kept = chunks.select("id", F.expr("id % 8 < CASE WHEN label % 2 = 0 THEN 8 ELSE 4 END").alias("kept"))
    hits = retrieval.nearest(queries, chunks, "label", 30).join(kept.where("kept"), "id").withColumn("parent_id", F.expr("id DIV 4"))
    return hits.groupBy("query_id", "parent_id").agg(F.min("rank").cast("long").alias("rank"))


@query(VECTORS + """, two AS (
        SELECT query_id, parent_id * 4 AS id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
            SELECT query_id, near.id // 4 AS parent_id, min(rank) AS rank FROM near JOIN q USING (query_id) WHERE rank <= 30 AND near.id % 8 < CASE WHEN label % 2 = 0 THEN 8 ELSE 4 END GROUP BY ALL)
    ), every AS (
        SELECT query_id, id, rank, 0 AS list FROM near WHERE rank <= 30 UNION ALL SELECT query_id, id, rank, 1 FROM two
    ), fused AS (
        SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS seen FROM every GROUP BY query_id, id
    )
    SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, id) AS place
    FROM fused QUALIFY place <= 8
""")
def vec2_rank_fusion(spark, sf_dir):
    """Ranks of bodies, and of the chunks whose expected questions are near, as one list."""
    queries, chunks = _vectors(spark, sf_dir)
    one = retrieval.nearest(queries, chunks, "label", 30)
    two = retrieval.ranked(question_hits(queries, chunks).withColumnRenamed("rank", "first_rank"), ["first_rank"]).withColumn("id", F.col("parent_id") * 4)
    found = retrieval.fused([one, two], 8)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.col("place").cast("long").alias("place"))


@query(VECTORS + """, every AS (
        SELECT query_id, id, rank, 0 AS list FROM near WHERE rank <= 5 AND id % 3 = 0 UNION ALL SELECT query_id, id, rank, 1 FROM near WHERE rank <= 10
    ), kept AS (SELECT query_id, id, min(list * 1000 + rank) AS seen FROM every GROUP BY query_id, id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, id) AS place FROM kept)
    SELECT query_id, id, place, round(0.1::DOUBLE + 0.05::DOUBLE * (place - 1), 6) AS distance FROM placed WHERE place <= 8
""")
def vec7_structural_first(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = stored(retrieval.nearest(queries, chunks, "label", 10).select("query_id", "id", "rank"), "near")
    merged = retrieval.first_wins([near.where("rank <= 5 AND id % 3 = 0"), near], 8)
    return merged.select("query_id", "id", F.col("place").cast("long").alias("place"), F.round(0.1 + 0.05 * (F.col("place") - 1), 6).alias("distance"))


@query(VECTORS + """
    SELECT query_id, max(CASE WHEN rank = 2 THEN id END) AS best, round(max(CASE WHEN rank = 3 THEN distance END) - max(CASE WHEN rank = 2 THEN distance END), 6) AS margin
    FROM near WHERE rank <= 3 GROUP BY query_id
""")
def win6_margins(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = retrieval.nearest(queries, chunks, "label", 3)
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    return near.groupBy("query_id").agg(at(2, "id").alias("best"), F.round(at(3, "distance") - at(2, "distance"), 6).alias("margin"))


@query("""
    SELECT vec_id, label FROM embeddings WHERE (label::VARCHAR = '3' OR label::VARCHAR IN ('5', '7')) AND label::VARCHAR <> '9'
""")
def flt1_metadata_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.where(retrieval.metadata_filter({"$or": [{"label": {"$eq": 3}}, {"label": {"$in": [5, "7"]}}]})).select("vec_id", "label")


@query("SELECT label, count(*) AS n, round(max(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1)), 4) AS off_unit FROM embeddings GROUP BY label")
def fn21_unit_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    length = F.sqrt(N.dot(F.col("embedding"), F.col("embedding")))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(length - 1)), 4).alias("off_unit"))


@query("""
    WITH patterns AS (SELECT DISTINCT regexp_replace(p_brand, '.$', '*') AS pattern, p_type FROM part),
    hits AS (
        SELECT p_partkey, pattern, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC, pattern) AS n
        FROM part JOIN patterns ON part.p_type = patterns.p_type AND part.p_brand LIKE replace(pattern, '*', '_')
    )
    SELECT p_partkey, pattern FROM hits WHERE n = 1
""")
def jn3_pattern_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    patterns = part.select(F.regexp_replace("p_brand", ".$", "*").alias("pattern"), F.col("p_type").alias("of_type")).distinct()
    match = (F.col("p_type") == F.col("of_type")) & T.matches_pattern(F.col("p_brand"), F.col("pattern"))
    return tables.best_match(part, patterns, match, "p_partkey", [F.length("pattern").desc(), "pattern"]).select("p_partkey", "pattern")


@query("""
    SELECT p_partkey, regexp_replace(upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '^([A-Z]*)0*([0-9]+)$', '\\1\\2') AS code FROM part
""")
def fn1_normalized_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_code(F.col("p_brand")).alias("code"))


@query("""
    SELECT n.n_nationkey, (
        SELECT p.p_name FROM part p WHERE p.p_size % 25 = n.n_nationkey AND p.p_type <> 'PROMO' ORDER BY length(p.p_name) DESC, p.p_name LIMIT 1
    ) AS pattern FROM nation n
""")
def jn5_longest_patterns(spark, sf_dir):
    """The longest pattern of each manual, from the patterns of one source; manuals without one stay."""
    part = table(spark, sf_dir, "part").where("p_type <> 'PROMO'").select((F.col("p_size") % 25).alias("n_nationkey"), "p_name")
    best = part.groupBy("n_nationkey").agg(F.min_by("p_name", F.struct(-F.length("p_name"), "p_name")).alias("pattern"))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(best, "n_nationkey", "left")


@query("""
    SELECT c.c_custkey, string_agg(CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderkey::VARCHAR END, ',' ORDER BY o.o_orderkey) AS finished,
        string_agg(CASE WHEN o.o_orderstatus <> 'F' THEN o.o_orderkey::VARCHAR END, ',' ORDER BY o.o_orderkey) AS others
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey
""")
def jn6_conditional_lists(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    done = F.col("o_orderstatus") == "F"
    both = customers.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")

    def listed(condition):
        keys = F.array_sort(F.collect_list(F.when(condition, F.col("o_orderkey"))))
        return F.when(F.size(keys) > 0, F.array_join(keys, ","))

    return both.groupBy("c_custkey").agg(listed(done).alias("finished"), listed(~done).alias("others"))


@query("""
    WITH m AS (SELECT p_partkey, p_brand, upper(p_name) AS model FROM part WHERE p_size % 2 = 1), k AS (SELECT p_brand, upper(regexp_replace(p_name, '[aeiou]', '*', 'g')) AS pattern FROM part WHERE p_size % 4 = 0)
    SELECT p_partkey FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.p_brand = m.p_brand AND m.model LIKE replace(k.pattern, '*', '_'))
""")
def jn7_without_match(spark, sf_dir):
    """Manuals whose own model no pattern of their table covers: patterns meet the models of their brand only."""
    part = table(spark, sf_dir, "part")
    manuals = part.where("p_size % 2 = 1").select("p_partkey", "p_brand", F.upper("p_name").alias("model"))
    patterns = part.where("p_size % 4 = 0").select("p_brand", F.upper(F.regexp_replace("p_name", "[aeiou]", "*")).alias("pattern")).distinct()
    covered = manuals.join(patterns, "p_brand").where(T.matches_pattern(F.col("model"), F.col("pattern"))).select("p_partkey").distinct()
    return manuals.select("p_partkey").join(covered, "p_partkey", "left_anti")


@query("""
    SELECT doc_id, 'add' AS action FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'delete' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def snk4_sync_plan(spark, sf_dir):
    return tables.sync_plan(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk6_remaining(spark, sf_dir):
    return tables.remaining(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
    SELECT text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents) GROUP BY text_md5
""")
def set6_content_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return rows.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""
    WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS v, 0 AS fresh FROM orders),
    new AS (SELECT l_orderkey AS k, max(l_linestatus) AS v, 1 AS fresh FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)
""")
def snk1_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(0).alias("fresh"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"), F.lit(1).alias("fresh"))
    return tables.upserted(old, new, ["k"])


@query("""
    SELECT event_type, user_id, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def snk2_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    return tables.first_wins(rows, ["event_type", "user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query("""
    SELECT conv_id, turn, role, substring(text, 1, 800) AS text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 8
""")
def win7_last_messages(spark, sf_dir):
    return tables.last_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "role", "text")


@query(r"""
    WITH first AS (
        SELECT conv_id, turn, trim(regexp_extract(text, '^([^.!?]*[.!?])', 1)) AS sentence FROM conversations WHERE role = 'assistant'
    )
    SELECT conv_id, turn, CASE WHEN sentence = '' THEN NULL ELSE sentence END AS sentence FROM first
""")
def str1_first_sentences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    sentence = F.trim(F.regexp_extract("text", r"^([^.!?]*[.!?])", 1))
    return rows.select("conv_id", "turn", F.when(sentence != "", sentence).alias("sentence"))


@query(r"""
    WITH u AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '[0-9]+')) AS codes FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN codes >= 2 THEN 'error_code' WHEN contains(text, '?') THEN 'vector' WHEN length(text) < 40 THEN 'none' ELSE 'general' END AS route
    FROM u
""")
def rte1_routes(spark, sf_dir):
    """Routes as one pass: the first branch that applies decides."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    route = (
        F.when(F.regexp_count("text", F.lit("[0-9]+")) >= 2, "error_code").when(F.contains("text", F.lit("?")), "vector").when(F.length("text") < 40, "none").otherwise("general")
    )
    return rows.select("conv_id", "turn", route.alias("route"))


@query("""
    WITH e AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'conv' WHEN role = 'user' THEN 'sources' WHEN role = 'assistant' THEN 'token' ELSE 'status' END AS type FROM conversations),
    p AS (SELECT *, list_position(['conv', 'status', 'sources', 'token', 'figures', 'done'], type) AS place FROM e)
    SELECT message_id, seq, type FROM (SELECT conv_id AS message_id, turn AS seq, type, place, max(place) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM p) WHERE so_far > place
""")
def str2_order_check(spark, sf_dir):
    """Events that come after one which should follow them, in the order conv, status, sources, token, figures, done."""
    kind = F.when(F.col("turn") == 0, "conv").when(F.col("role") == "user", "sources").when(F.col("role") == "assistant", "token").otherwise("status")
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("seq"), kind.alias("type"))
    return answers.out_of_order(events, ("conv", "status", "sources", "token", "figures", "done"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS moment, user_id FROM events WHERE event_type = 'purchase'")
def fn28_kst(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select("event_id", T.kst(F.col("ts")).alias("moment"), "user_id")
