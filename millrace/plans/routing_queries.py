"""Routing, answers and caps over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import answers, retrieval, routing
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import VECTORS, _vectors


@query(VECTORS + """, codes AS (SELECT query_id, p_partkey AS id FROM q JOIN part ON p_partkey = query_id WHERE p_size <= 10),
    absent AS (SELECT query_id, p_partkey AS id FROM q JOIN part ON p_partkey = query_id WHERE p_size BETWEEN 11 AND 20),
    every AS (
        SELECT query_id, 'error_code' AS route, id, 0.0::DOUBLE AS distance, 1 AS place, true AS used FROM codes
        UNION ALL SELECT query_id, 'feature_absent', id, 1.0, 1, true FROM absent
        UNION ALL SELECT query_id, 'vector', id, distance, rank, distance < 0.9 FROM near
            WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM codes) AND query_id NOT IN (SELECT query_id FROM absent)
    )
    SELECT q.query_id, coalesce(route, 'none') AS route, every.id, round(distance, 6) AS distance, place::BIGINT AS place, coalesce(used, false) AS used
    FROM q LEFT JOIN every USING (query_id)
""")
def rte2_service_router(spark, sf_dir):
    """Codes and features are looked up in ``part``; only questions that neither answers are searched."""
    queries, chunks = _vectors(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("id"), "p_size")
    known = queries.select("query_id").join(parts, "query_id")
    codes = known.where("p_size <= 10").select("query_id", "id", F.lit(1).alias("rank"))
    absent = known.where("p_size BETWEEN 11 AND 20").select("query_id", "id")
    found = routing.routed(queries, codes, absent, lambda rest: retrieval.nearest(rest, chunks, "label", 5))
    return found.select("query_id", "route", "id", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"), "used")


@query(VECTORS + """, g AS (SELECT query_id, min(distance) AS least, max(CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END) AS verdict FROM near WHERE rank BETWEEN 2 AND 4 GROUP BY query_id)
    SELECT query_id, round(least, 6) AS least, CASE WHEN least < 0.85 THEN true WHEN least >= 1.25 THEN false ELSE verdict = 1 END AS answered FROM g
""")
def flt12_gate(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = retrieval.nearest(queries, chunks, "label", 4).where("rank >= 2")
    return routing.gated(near, F.col("id") % 2 == 0).withColumn("least", F.round("least", 6))


@query("""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM a WHERE n <= 6)
    SELECT l_suppkey, l_orderkey, l_linenumber, place FROM b WHERE place <= 24
""")
def win8_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    found = routing.capped(rows, "l_suppkey", "l_orderkey", [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 6, 24)
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("""
    SELECT c.conv_id, c.turn, substring(c.text, 1, 220) AS snippet, '(p. ' || array_to_string(list_sort(list_distinct(list(d.turn))), ', ') || ')' AS pages
    FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn < c.turn WHERE c.role = 'assistant' GROUP BY ALL
""")
def fn33_citations(spark, sf_dir):
    """Every earlier turn of the conversation is a cited page; the running set grows along the turns, without pairs."""
    rows = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", F.substring("text", 1, 220).alias("snippet"))
    met = rows.withColumn("p", F.collect_set("turn").over(before)).where("role = 'assistant' AND size(p) > 0")
    return met.dropDuplicates(["conv_id", "turn", "snippet"]).select("conv_id", "turn", "snippet", answers.citation(F.col("p")).alias("pages"))


@query(r"""
    WITH a AS (SELECT conv_id, turn, text, regexp_extract(text, '^([^.!?\n]{0,78}[.!?\n])', 1) AS head FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, contains(head, 'the') AS about FROM a WHERE head <> ''
""")
def str1_first_sentence_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    head = answers.first_sentence(F.col("text"))
    return rows.where(head.rlike(r"(?s)[.!?\n]\s*$") & (F.length(F.regexp_extract("text", r"^([^.!?\n]{0,78}[.!?\n])", 1)) > 0)).select("conv_id", "turn", F.contains(head, F.lit("the")).alias("about"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IN (1, 2) ORDER BY vec_id LIMIT 25 OFFSET 10")
def top7_paging(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "label")
    found = rows.where(retrieval.metadata_filter({"label": {"$in": [1, 2]}}))
    return found.orderBy("seq", "id").offset(10).limit(25).select("id", "label")


@query("SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY label HAVING count(*) >= 3")
def agg1_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("label != 3")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("""
    WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ps, list_sort(list(DISTINCT o_orderstatus)) AS ss FROM orders GROUP BY o_custkey)
    SELECT o_custkey, len(ps) + len(ss) AS n, list_has_any(ps, ['1-URGENT']) AS urgent, list_has_any(ss, ['F', 'P']) AS covered FROM s
""")
def set4_coverage(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ps"), F.collect_set("o_orderstatus").alias("ss"))
    return sets.select(
        "o_custkey",
        F.size(F.array_union("ps", "ss")).cast("long").alias("n"),
        F.arrays_overlap("ps", F.array(F.lit("1-URGENT"))).alias("urgent"),
        F.arrays_overlap("ss", F.array(F.lit("F"), F.lit("P"))).alias("covered"),
    )
