"""Cleaning, catalogue searches, sampling and windows over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.numbers import squared_distance
from millrace.operators import chunking, retrieval, tables
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import VECTORS, _vectors

#: Glyphs that page layouts leave behind (scripts that the manuals don't use, byte order marks, marks of
#: width and direction, private use), and blank lines that their removal leaves.
JUNK = r"[\x{0780}-\x{0DFF}\x{FEFF}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{E000}-\x{F8FF}]"
BLANK_LINES = r"\n[ \t]*\n(?:[ \t]*\n)+"


@query(rf"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{JUNK}', '', 'g'), '{BLANK_LINES}', chr(10) || chr(10), 'g')) AS clean_md5
    FROM documents WHERE text IS NOT NULL
""")
def chk24_cleaned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(F.regexp_replace(F.regexp_replace("text", JUNK, ""), BLANK_LINES, "\n\n")).alias("clean_md5"))


@query(r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL
    ), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l)
    SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN length(line) < 150 AND before IS NOT NULL THEN before || chr(10) || line ELSE line END AS target
    FROM b WHERE NOT regexp_matches(lower(line), 'copyright|license|all rights')
""")
def chk23_question_targets(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", "line")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    short = (F.length("line") < 150) & F.col("before").isNotNull()
    marked = rows.withColumn("before", before).where(~F.lower("line").rlike("copyright|license|all rights"))
    return marked.select("doc_id", "line_no", F.when(short, F.concat("before", F.lit("\n"), "line")).otherwise(F.col("line")).alias("target"))


@query("""
    SELECT o_orderkey, max(CASE WHEN abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 30 THEN 1 ELSE 0 END) = 1 AS hit
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def flt20_tolerance(spark, sf_dir):
    orders, line = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    near = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))) <= 30
    return orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.bool_or(near).alias("hit"))


@query("""
    SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND contains(lower(replace(p_name, ' ', '')), 'red') ORDER BY p_name, p_partkey LIMIT 30
""")
def flt17_catalog_search(spark, sf_dir):
    plain = F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    return table(spark, sf_dir, "part").where((F.col("p_type") == "ECONOMY") & F.contains(plain, F.lit("red"))).orderBy("p_name", "p_partkey").limit(30).select("p_partkey", "p_name")


@query("""
    SELECT c_custkey, replace(replace('{name} from {place}', '{name}', c_name), '{place}', n_name) AS question FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def jn8_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    filled = F.replace(F.replace(F.lit("{name} from {place}"), F.lit("{name}"), F.col("c_name")), F.lit("{place}"), F.col("n_name"))
    return rows.select("c_custkey", filled.alias("question"))


@query("""
    SELECT p_name, length(p_name)::BIGINT AS size, count(*) AS parts FROM part GROUP BY p_name
""")
def agg5_known_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.length("p_name").cast("long").alias("size"), F.count(F.lit(1)).alias("parts"))


@query("""
    SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 9) AS hit_rate, round(avg(coalesce(CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END, 1.0)), 6) AS mean_all,
        round(avg(CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END), 6) AS mean_present
    FROM events GROUP BY event_type
""")
def agg7_means_both_ways(spark, sf_dir):
    """Rows without a value: counted as 1.0, and left out."""
    value = F.when(F.col("user_id") % 3 != 0, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg((F.col("value") > 50).cast("int")), 9).alias("hit_rate"), F.round(F.avg(F.coalesce(value, F.lit(1.0))), 6).alias("mean_all"), F.round(F.avg(value), 6).alias("mean_present")
    )


@query("""
    WITH b AS (SELECT DISTINCT p_brand FROM part), q AS (SELECT p_type, min(p_partkey) AS place FROM part GROUP BY p_type), c AS (SELECT p_type, count(DISTINCT p_brand) AS hits FROM part WHERE p_size <= 20 GROUP BY p_type)
    SELECT p_type, (SELECT count(*) FROM b) - coalesce(hits, 0) AS misses, row_number() OVER (ORDER BY (SELECT count(*) FROM b) - coalesce(hits, 0), place) AS nth FROM q LEFT JOIN c USING (p_type) QUALIFY nth <= 4
""")
def agg16_coverage(spark, sf_dir):
    """The four questions that fewest models can't answer, in their own order at ties."""
    part = table(spark, sf_dir, "part")
    models = part.select("p_brand").distinct().agg(F.count(F.lit(1)).alias("models"))  # one row
    asked = part.groupBy("p_type").agg(F.min("p_partkey").alias("at"), F.count_distinct(F.when(F.col("p_size") <= 20, F.col("p_brand"))).alias("hits"))
    misses = models.select("models").scalar() - F.col("hits")
    top = asked.withColumn("misses", misses).orderBy("misses", "at").limit(4)  # the report has four rows
    return top.select("p_type", "misses", F.row_number().over(Window.orderBy("misses", "at")).cast("long").alias("nth"))


@query("""
    SELECT p_type, string_agg(p_brand || '=' || p_name, ';' ORDER BY p_brand) AS catalog FROM (
        SELECT p_type, p_brand, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY p_type, p_brand) GROUP BY p_type
""")
def agg21_catalog(spark, sf_dir):
    last = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.max_by("p_name", "p_partkey").alias("p_name"))
    entry = F.concat("p_brand", F.lit("="), "p_name")
    listed = F.array_sort(F.collect_list(F.struct("p_brand", entry.alias("e"))))
    return last.groupBy("p_type").agg(F.array_join(F.transform(listed, lambda x: x["e"]), ";").alias("catalog"))


@query("""
    WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM r WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5
""")
def win10_even_sampling(spark, sf_dir):
    """Rows spread evenly over each source; places within a source are counted over ranges of rows, not in one task."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    counts = docs.groupBy("source").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 5)).alias("step"))
    rows = tables.placed(docs, "source", ["doc_id"]).join(counts.withColumnRenamed("source", "step_source"), F.col("source").eqNullSafe(F.col("step_source")))
    return rows.where((F.col("place") % F.col("step") == 0) & (F.floor(F.col("place") / F.col("step")) < 5)).select("source", "doc_id")


@query("""
    SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def win4_neighbours(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", (micros - F.lag(micros).over(w)).alias("gap"), F.lead("event_type").over(w).alias("following"))


@query("""
    SELECT label, vec_id, place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS place FROM embeddings) WHERE place <= 10
""")
def top5_shuffled(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    found = retrieval.ranked(rows, [F.md5(F.col("vec_id").cast("string")), "vec_id"], 10, partition="label", name="place")
    return found.select("label", "vec_id", F.col("place").cast("long").alias("place"))


@query(VECTORS + """, t AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS least FROM near WHERE rank BETWEEN 2 AND 12)
    SELECT query_id, id, round(1 - distance / 2, 6) AS similarity FROM t WHERE distance <= least + 0.06
""")
def top8_close_to_best(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = retrieval.nearest(queries, chunks, "label", 12).where("rank >= 2")
    least = F.min("distance").over(Window.partitionBy("query_id"))
    return near.withColumn("least", least).where("distance <= least + 0.06").select("query_id", "id", F.round(1 - F.col("distance") / 2, 6).alias("similarity"))


@query(VECTORS + """
    SELECT query_id, min(CASE WHEN id = query_id THEN rank END) AS hit_rank, round(min(distance), 6) AS least, bool_or(id = query_id AND rank <= 3) AS hit FROM near GROUP BY query_id
""")
def evl9_source_hits(spark, sf_dir):
    """The rank of a question's own chunk is the number of chunks before it: no ranking is written out."""
    queries, chunks = _vectors(spark, sf_dir)
    pairs = queries.join(chunks, "label").select("query_id", "id", squared_distance(F.col("query_vector"), F.col("vector")).alias("distance"))
    own = queries.select("query_id", squared_distance(F.col("query_vector"), F.col("query_vector")).alias("own_distance"))
    before = F.struct("distance", "id") < F.struct("own_distance", "query_id")
    counted = pairs.join(own, "query_id").groupBy("query_id").agg((F.count_if(before) + 1).alias("hit_rank"), F.round(F.min("distance"), 6).alias("least"))
    return counted.select("query_id", "hit_rank", "least", (F.col("hit_rank") <= 3).alias("hit"))


@query("""
    SELECT source, count(*) AS pieces, max(length(piece))::BIGINT AS longest, bool_and(length(piece) <= 700) AS fits FROM (
        SELECT source, substring(text, p + 1, 700) AS piece FROM (SELECT source, text, unnest(range(0, greatest(length(text), 1), 595)) AS p FROM documents WHERE text IS NOT NULL)) GROUP BY source
""")
def evl16_piece_checks(spark, sf_dir):
    pieces = chunking.sliding(table(spark, sf_dir, "documents").select("source", "text")).select("source", F.length("piece").alias("n"))
    return pieces.groupBy("source").agg(F.count(F.lit(1)).alias("pieces"), F.max("n").cast("long").alias("longest"), F.bool_and(F.col("n") <= 700).alias("fits"))


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events
""")
def chk13_carried_headers(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").select("event_id", header.alias("header"))


@query("""
    SELECT CASE WHEN toxic = 1 THEN 'decline' ELSE 'normal' END AS part, count(*) AS n, round(avg(n_chars) FILTER (n_chars > 500), 6) AS mean_long FROM labels JOIN documents USING (doc_id) GROUP BY ALL
""")
def evl12_split_means(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    part = F.when(F.col("toxic") == 1, "decline").otherwise("normal")
    return rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("n_chars") > 500, F.col("n_chars"))), 6).alias("mean_long"))
