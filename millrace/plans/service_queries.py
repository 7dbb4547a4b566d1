"""The service's path over the given tables: code lookups, features, filters from questions, candidates, routes.

Tables that the reference keeps stand for given ones: parts for code entries, models and features, events for questions
(``scalar_queries.questions``), embeddings for chunks and for questions about them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval, routing, tables
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import VECTORS, _vectors, question_hits
from millrace.plans.scalar_queries import CODES_OF_QUESTIONS, QUESTIONS, questions

ENTRIES = """
    e AS (
        SELECT p_partkey AS entry_id, p_brand AS brand, p_type AS category, 'E' || (p_size % 45) AS code_norm, p_name AS title,
            CASE WHEN p_partkey % 3 = 0 THEN 'alias' ELSE 'primary' END AS kind
        FROM part
    )
"""
HITS = "WITH " + CODES_OF_QUESTIONS + "," + ENTRIES + """,
    v AS (
        SELECT DISTINCT q_id, brand, category, unnest(list_concat([code], list_transform(range(1, length(code) + 1),
            lambda i: substring(code, 1, i - 1) || translate(substring(code, i, 1), 'O0I1S5B8', '0O1I5S8B') || substring(code, i + 1)))) AS variant
        FROM cod
    ), hit AS (
        SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY kind = 'primary' DESC, entry_id) AS place
        FROM (SELECT DISTINCT v.q_id, e.entry_id, e.kind, e.title FROM v JOIN e ON e.brand = v.brand AND e.category = v.category AND e.code_norm = v.variant)
    )
"""


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS entry_id", "p_brand AS brand", "p_type AS category", "concat('E', p_size % 45) AS code_norm", "p_name AS title", "CASE WHEN p_partkey % 3 = 0 THEN 'alias' ELSE 'primary' END AS kind"
    )


#: Entries of a list that meet a question at once.
ENTRY_BLOCK = 1024


def _wanted(spark, sf_dir):
    """(q_id, codes, wanted): what a question looks up, by brand and category, and a digest of it."""
    codes = questions(spark, sf_dir).select("q_id", "brand", "category", F.explode(T.codes_in(F.col("text"))).alias("code"))
    variants = codes.select("q_id", "brand", "category", F.explode(T.code_variants(F.col("code"))).alias("code_norm")).where("brand IS NOT NULL AND category IS NOT NULL AND code_norm IS NOT NULL")
    sets = variants.groupBy("q_id").agg(F.array_sort(F.collect_set(F.struct("brand", "category", "code_norm"))).alias("codes"))
    return sets.withColumn("wanted", F.md5(F.to_json("codes")))


def _lists(wanted, entries, most=None):
    """(wanted, entry_id, kind, title, place): the entries of each distinct set of codes, in order."""
    once = wanted.select("wanted", "codes").dropDuplicates(["wanted"]).select("wanted", F.inline("codes"))
    found = once.join(entries, ["brand", "category", "code_norm"]).select("wanted", "entry_id", "kind", "title").distinct()
    return retrieval.ranked(found, [(F.col("kind") == "primary").desc(), "entry_id"], most, partition="wanted", name="place")


def _hits(spark, sf_dir, most=None):
    """(q_id, entry_id, kind, title, place): entries of a question's codes within its brand and category. Many questions
    look up the same codes: entries are put in order once for each set of codes, and lists meet questions in blocks."""
    wanted = _wanted(spark, sf_dir)
    row = F.struct("place", "entry_id", "kind", "title")
    blocks = _lists(wanted, _entries(spark, sf_dir), most).groupBy("wanted", F.expr(f"place DIV {ENTRY_BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("held"))
    return wanted.select("q_id", "wanted").join(blocks, "wanted").select("q_id", F.inline("held"))


@query(HITS + "SELECT q_id, entry_id, kind, place FROM hit")
def jn1_code_lookup(spark, sf_dir):
    return _hits(spark, sf_dir).select("q_id", "entry_id", "kind", F.col("place").cast("long").alias("place"))


FEATURES = """
    f AS (SELECT p_brand AS brand, p_type AS feature, regexp_replace(p_name, '[aeiou]', '*', 'g') AS pattern, p_size % 2 AS has FROM part),
    a AS (SELECT p_partkey, p_brand AS brand, CASE p_type WHEN 'PROMO' THEN 'ECONOMY' ELSE p_type END AS feature, p_name AS model FROM part WHERE p_size % 5 < 3),
    m AS (
        SELECT p_partkey, has FROM a JOIN f ON f.brand = a.brand AND f.feature = a.feature AND a.model LIKE replace(f.pattern, '*', '_')
        QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY pattern, has) = 1
    )
"""


def _features(spark, sf_dir):
    """(p_partkey, has): whether a model has the asked feature, by the first pattern that covers it; null if none does.
    A feature that another implies is looked up there. Patterns and models meet once each, however many rows hold them."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("feature"), F.regexp_replace("p_name", "[aeiou]", "*").alias("pattern"), (F.col("p_size") % 2).alias("has"))
    known = known.groupBy("brand", "feature", "pattern").agg(F.min("has").alias("has"))
    asked = part.where("p_size % 5 < 3").select("p_partkey", F.col("p_brand").alias("brand"), F.when(F.col("p_type") == "PROMO", "ECONOMY").otherwise(F.col("p_type")).alias("feature"), F.col("p_name").alias("model"))
    models = asked.select("brand", "feature", "model").distinct()
    met = models.join(known, ["brand", "feature"]).where(T.matches_pattern(F.col("model"), F.col("pattern")))
    first = met.groupBy("brand", "feature", "model").agg(F.min(F.struct("pattern", "has")).alias("first"))
    found = asked.join(first, ["brand", "feature", "model"]).groupBy("p_partkey").agg(F.min("first").alias("first")).select("p_partkey", "first.has")
    return asked.select("p_partkey").join(found, "p_partkey", "left")


@query("WITH " + FEATURES + "SELECT a.p_partkey, m.has FROM a LEFT JOIN m USING (p_partkey)")
def jn4_features(spark, sf_dir):
    return _features(spark, sf_dir)


#: Keywords in order of priority with what they stand for.
CATEGORIES = [("bolt", "A"), ("old bolt", "B"), ("ring", "C"), ("gear", "D"), ("widget", "A")]
BRANDS = [("Brand#2", "two"), ("Brand#1", "one"), ("BRAND", "any")]


@query(f"""
    WITH q AS (SELECT p_partkey, 'how about the ' || p_name || ' of ' || p_brand AS text FROM part),
    k AS (SELECT DISTINCT p_name AS model FROM part WHERE p_size % 2 = 0),
    m AS (SELECT p_partkey, model FROM q JOIN k ON contains(text, model) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(model) DESC, model) = 1),
    c AS (SELECT q.p_partkey, CASE {' '.join(f"WHEN contains(text, '{k}') THEN '{v}'" for k, v in CATEGORIES)} END AS category,
        CASE {' '.join(f"WHEN contains(text, '{k}') THEN '{v}'" for k, v in BRANDS)} END AS brand, model FROM q LEFT JOIN m USING (p_partkey))
    SELECT *, (category IS NOT NULL)::INT + (brand IS NOT NULL)::INT + (model IS NOT NULL)::INT AS clauses FROM c
""")
def flt3_detected_filters(spark, sf_dir):
    """Category and brand by the first keyword, and the longest known model, that a question names. Models have two
    words, so that they meet a question's pairs of words before they are compared."""
    part = table(spark, sf_dir, "part")
    asked = part.select("p_partkey", F.concat(F.lit("how about the "), "p_name", F.lit(" of "), "p_brand").alias("text"))
    known = part.where("p_size % 2 = 0").select(F.col("p_name").alias("model")).distinct()
    words = F.split("text", " ")
    pairs = asked.select("p_partkey", "text", F.explode(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).alias("model"))
    longest = pairs.join(known, "model").where(F.contains("text", F.col("model"))).groupBy("p_partkey").agg(F.min_by("model", F.struct(-F.length("model"), "model")).alias("model"))
    first = lambda pairs: F.coalesce(*[F.when(F.contains("text", F.lit(k)), F.lit(v)) for k, v in pairs])
    found = asked.join(longest, "p_partkey", "left").select("p_partkey", first(CATEGORIES).alias("category"), first(BRANDS).alias("brand"), "model")
    return found.withColumn("clauses", sum(F.col(c).isNotNull().cast("int") for c in ("category", "brand", "model")))


@query("""
    SELECT vec_id AS id FROM embeddings WHERE (label = 1 OR label IN (2, 3)) AND vec_id = 7 * (vec_id // 7) AND label <> 2 ORDER BY id
""")
def flt2_merged_filters(spark, sf_dir):
    """A clause joined to an existing filter, in the nested filter language."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 7).alias("rest"))
    given = {"$or": [{"label": 1}, {"label": {"$in": [2, 3]}}]}
    merged = retrieval.metadata_filter({"$and": [given, {"rest": {"$eq": 0}}, {"label": {"$in": [1, 3]}}]})
    return rows.where(merged).select("id")


@query("WITH " + QUESTIONS + "," + ENTRIES + r"""
    , t AS (SELECT q_id, unnest(regexp_extract_all(upper(text), '[A-Z0-9]+')) AS code FROM q), k AS (SELECT DISTINCT code_norm AS code FROM e)
    SELECT q_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM t JOIN k USING (code) GROUP BY q_id
""")
def flt5_codes_in_text(spark, sf_dir):
    """Registered codes between boundaries of a question, whatever their case: codes are runs of letters and digits, so
    a question's runs meet them by equality."""
    runs = questions(spark, sf_dir).select("q_id", F.explode(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9]+"), F.lit(0))).alias("code_norm")).distinct()
    found = runs.join(_entries(spark, sf_dir).select("code_norm").distinct(), "code_norm")
    return found.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_list("code_norm")), ",").alias("codes"))


@query("WITH " + QUESTIONS + "," + ENTRIES + r"""
    , t AS (SELECT q_id, unnest(regexp_extract_all(upper(text), '[A-Z0-9()]{2,}')) AS code, generate_subscripts(regexp_extract_all(upper(text), '[A-Z0-9()]{2,}'), 1) AS pos FROM q),
    f AS (SELECT q_id, code, min(pos) AS pos FROM t WHERE code IN (SELECT code_norm FROM e) GROUP BY ALL)
    SELECT q_id, string_agg(code, ',' ORDER BY pos) AS codes FROM f GROUP BY q_id
""")
def flt6_known_tokens(spark, sf_dir):
    tokens = questions(spark, sf_dir).select("q_id", F.posexplode(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z0-9()]{2,}"), F.lit(0))).alias("pos", "code_norm"))
    first = tokens.groupBy("q_id", "code_norm").agg(F.min("pos").alias("pos")).join(_entries(spark, sf_dir).select("code_norm").distinct(), "code_norm")
    return first.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code_norm"))), lambda x: x["code_norm"]), ",").alias("codes"))


@query(r"""
    WITH q AS (SELECT p_partkey, 'My brand' || p_size || 'X' || (p_partkey % 9) || ', or BRAND' || (p_partkey % 60) || '/brand7x' AS text FROM part),
    k AS (SELECT DISTINCT 'BRAND' || p_size || CASE WHEN p_partkey % 2 = 0 THEN 'X' || (p_partkey % 9) ELSE '' END AS model FROM part),
    t AS (SELECT p_partkey, unnest(regexp_extract_all(upper(text), '[A-Z0-9]+')) AS model FROM q)
    SELECT p_partkey, model FROM t JOIN k USING (model) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(model) DESC, model) = 1
""")
def flt7_models_in_text(spark, sf_dir):
    """The longest known model between boundaries of a question."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.expr("concat('BRAND', p_size, CASE WHEN p_partkey % 2 = 0 THEN concat('X', p_partkey % 9) ELSE '' END)").alias("model")).distinct()
    text = F.expr("concat('My brand', p_size, 'X', p_partkey % 9, ', or BRAND', p_partkey % 60, '/brand7x')")
    runs = part.select("p_partkey", F.explode(F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9]+"), F.lit(0))).alias("model"))
    return runs.join(known, "model").groupBy("p_partkey").agg(F.min_by("model", F.struct(-F.length("model"), "model")).alias("model"))


@query(VECTORS + """, k AS (SELECT query_id, id, rank, NOT (id % 3 = 0 AND distance >= 1.5) AS keep FROM near WHERE rank <= 3)
    SELECT query_id, id, rank FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS left_over FROM k) WHERE keep OR NOT left_over
""")
def flt11_error_guard(spark, sf_dir):
    """Far chunks about errors go, unless nothing would be left."""
    near = retrieval.nearest(*_vectors(spark, sf_dir), "label", 3).withColumn("keep", ~((F.col("id") % 3 == 0) & (F.col("distance") >= 1.5)))
    some = F.max("keep").over(Window.partitionBy("query_id"))
    return near.withColumn("some", some).where("keep OR NOT some").select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("""
    WITH t AS (SELECT p_brand, p_partkey, split_part(p_name, ' ', 2) AS leaf FROM part WHERE p_name IN ('old bolt', 'red ring', 'hot gear', 'red gear', 'old ring') OR contains(p_name, 'widget') OR contains(p_name, 'bolt'))
    SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS chunks, count(DISTINCT leaf) AS leaves FROM t GROUP BY p_brand HAVING count(DISTINCT leaf) >= 3
""")
def flt15_chunks_by_title(spark, sf_dir):
    """Chunks of each model whose title is in a list or holds a word, for models with several leaf titles (AGG-6)."""
    part = table(spark, sf_dir, "part")
    rows = part.where(F.col("p_name").isin("old bolt", "red ring", "hot gear", "red gear", "old ring") | F.contains("p_name", F.lit("widget")) | F.contains("p_name", F.lit("bolt")))
    ids = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string"))
    found = rows.groupBy("p_brand").agg(F.array_join(ids, ",").alias("chunks"), F.count_distinct(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("leaves"))
    return found.where("leaves >= 3")


@query(VECTORS + """, ask AS (SELECT q.query_id, d.source, d.text AS answer, list_last(regexp_extract_all(k.text, '[a-z]{4,}')) AS keyword FROM q JOIN documents d ON d.doc_id = q.query_id JOIN documents k ON k.doc_id = q.query_id + 1 WHERE d.text IS NOT NULL),
    ca AS (SELECT query_id, string_agg(text, ' ') AS candidates FROM near JOIN documents ON doc_id = id WHERE rank <= 4 AND id <> query_id GROUP BY query_id)
    SELECT query_id, CASE WHEN contains(answer, keyword) OR contains(coalesce(candidates, ''), keyword) THEN 'C' WHEN EXISTS (SELECT 1 FROM documents m WHERE m.source = ask.source AND contains(m.text, keyword)) THEN 'B' ELSE 'A' END AS class
    FROM ask LEFT JOIN ca USING (query_id) WHERE keyword IS NOT NULL
""")
def flt16_triage(spark, sf_dir):
    """C: the keyword is in the answer or its candidates; B: it is in another chunk of the model; A: it is nowhere. A
    keyword is part of a text if it is part of one of its words: keywords meet distinct words of the model by substrings."""
    queries, chunks = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    words = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))
    keywords = docs.select((F.col("doc_id") - 1).alias("query_id"), F.get(words, F.size(words) - 1).alias("keyword")).where("keyword IS NOT NULL")
    asked = queries.select("query_id").join(docs.where("text IS NOT NULL").withColumnRenamed("doc_id", "query_id"), "query_id").join(keywords, "query_id")
    held = retrieval.nearest(queries, chunks, "label", 4).where("id <> query_id").select("query_id", F.col("id").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id").select("query_id", "text")
    shown = held.join(keywords, "query_id").groupBy("query_id").agg(F.bool_or(F.contains("text", F.col("keyword"))).alias("shown"))
    known = docs.select("source", F.explode(F.array_distinct(words)).alias("word")).distinct()
    met = tables.containing(known, "word", asked, "keyword").join(known, "word").select("source", "keyword").distinct().withColumn("known", F.lit(True))
    rows = asked.join(shown, "query_id", "left").join(met, ["source", "keyword"], "left")
    return rows.select("query_id", F.when(F.contains("text", F.col("keyword")) | F.col("shown"), "C").when(F.col("known"), "B").otherwise("A").alias("class"))


@query("""
    SELECT event_id, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN o_custkey = user_id THEN 'own' ELSE 'foreign' END AS access FROM events LEFT JOIN orders ON o_orderkey = event_id
""")
def flt18_ownership(spark, sf_dir):
    """Whether the row that a user asks for, by its key, is theirs, somebody else's, or missing."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("owner"))
    asked = table(spark, sf_dir, "events").select("event_id", "user_id").join(rows, "event_id", "left")
    access = F.when(F.col("owner").isNull(), "missing").when(F.col("owner") == F.col("user_id"), "own").otherwise("foreign")
    return asked.select("event_id", access.alias("access"))


# Candidates ----------------------------------------------------------------------------------------------------------
@query(VECTORS + """, every AS (
        SELECT query_id // 40 AS q, id, distance FROM near WHERE rank <= 20
        UNION ALL SELECT query_id // 40, id, distance FROM near WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10
    ), merged AS (SELECT q, id, min(distance) AS distance FROM every GROUP BY ALL)
    SELECT q AS query_id, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS place FROM merged QUALIFY place <= 8
""")
def vec3_sub_queries(spark, sf_dir):
    """Candidates of several sub-queries, with and without a filter on the kind, at their least distance."""
    queries, chunks = _vectors(spark, sf_dir)
    found = retrieval.nearest(queries, chunks, "label", 20).unionByName(retrieval.nearest(queries, chunks.where("id % 3 = 0"), "label", 10))
    merged = retrieval.least_distance(found.withColumn("query_id", F.expr("query_id DIV 40")))
    best = retrieval.ranked(merged, ["distance", "id"], 8, name="place")
    return best.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"))


@query(VECTORS + """, s AS (SELECT query_id, id, distance FROM near WHERE query_id % 3 = 0 AND id % 7 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 3)
    SELECT query_id, id, 0.3::DOUBLE AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM s
""")
def vec6_chapter_candidates(spark, sf_dir):
    """For questions about faults the chunks of the model's chapter, best first, all at one distance."""
    queries, chunks = _vectors(spark, sf_dir)
    found = retrieval.nearest(queries.where("query_id % 3 = 0"), chunks.where("id % 7 = 0"), "label", 3)
    return found.select("query_id", "id", F.lit(0.3).alias("distance"), F.col("rank").cast("long").alias("place"))


@query(VECTORS + """, f AS (SELECT query_id, id, distance FROM near WHERE id % 50 = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 3)
    SELECT query_id, id, round(distance, 6) AS distance FROM f
    UNION ALL SELECT query_id, id, round(distance, 6) FROM near WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM f)
""")
def vec8_fallback(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    found = retrieval.nearest(queries, chunks.where("id % 50 = 1"), "label", 3).select("query_id", "id", "distance")
    rows = retrieval.with_fallback(found, queries, lambda missing: retrieval.nearest(missing, chunks, "label", 3).select("query_id", "id", "distance"))
    return rows.select("query_id", "id", F.round("distance", 6).alias("distance"))


@query(VECTORS + "SELECT query_id, id, round(1.0::DOUBLE + 0.01::DOUBLE * (rank - 1), 6) AS distance FROM near WHERE rank <= 8")
def vec9_rank_distances(spark, sf_dir):
    found = retrieval.nearest(*_vectors(spark, sf_dir), "label", 8)
    return found.select("query_id", "id", F.round(1.0 + 0.01 * (F.col("rank") - 1), 6).alias("distance"))


@query(VECTORS + """, first AS (
        SELECT query_id, near.id // 4 AS parent_id, min(rank) AS rank FROM near JOIN q USING (query_id) WHERE rank <= 30 AND near.id % 8 < CASE WHEN label % 2 = 0 THEN 8 ELSE 4 END GROUP BY ALL
    )
    SELECT query_id, parent_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM first QUALIFY place <= 5
""")
def vec10_question_index(spark, sf_dir):
    """Hits in an index of expected questions lead to the chunk that each belongs to (JN-9)."""
    first = question_hits(*_vectors(spark, sf_dir))
    return retrieval.ranked(first, ["rank"], 5, name="place").withColumn("place", F.col("place").cast("long"))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings WHERE vec_id % 9 = 4 OR vec_id % 11 = 0")
def top2_get_by_ids(spark, sf_dir):
    """Rows of wanted ids come in the collection's order, whatever order the ids were asked in."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"))
    wanted = rows.where("id % 9 = 4 OR id % 11 = 0").select("id", (-F.col("id")).alias("asked"))
    found = rows.join(wanted, "id").repartitionByRange("seq")
    # places over ranges of the order: counts of the ranges before, and the number within a range
    part = found.withColumn("part", F.spark_partition_id()).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("seq")))
    sizes = part.groupBy("part").agg(F.max("nth").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(before, "part").select("id", (F.col("before") + F.col("nth")).alias("place"))


# Joins ---------------------------------------------------------------------------------------------------------------
VERSIONS = "v AS (SELECT d.doc_id, d.lang, d.source, l.quality AS old, CASE WHEN d.n_chars % 5 = 0 THEN 1 - l.quality ELSE l.quality END AS new FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 7 <> 0)"


@query("WITH " + VERSIONS + "SELECT lang, count_if(old = new) AS unchanged, count_if(old <> new) AS flipped, count_if(old < new) AS gained FROM v GROUP BY lang")
def jn10_label_versions(spark, sf_dir):
    """Two versions of a label set by question and model; rows of one version only are left out."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", "lang", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("old")), "doc_id").withColumn("new", F.expr("CASE WHEN n_chars % 5 = 0 THEN 1 - old ELSE old END"))
    return both.groupBy("lang").agg(F.count_if(F.expr("old = new")).alias("unchanged"), F.count_if(F.expr("old <> new")).alias("flipped"), F.count_if(F.expr("old < new")).alias("gained"))


@query("""
    WITH o AS (SELECT conv_id, turn, range(conv_id % 40, conv_id % 40 + 12) AS ids FROM conversations),
    p AS (SELECT conv_id, turn, unnest(ids) AS doc_id, generate_subscripts(ids, 1) - 1 AS pos FROM o),
    j AS (SELECT p.*, l.quality FROM p LEFT JOIN labels l USING (doc_id))
    SELECT conv_id, turn, min(CASE WHEN quality = 1 THEN pos END) AS first_relevant, count_if(quality IS NULL) AS unjudged FROM j GROUP BY ALL
""")
def jn11_judged_orders(spark, sf_dir):
    """Arrays of candidate ids, place by place against a table of judgments."""
    orders = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("sequence(conv_id % 40, conv_id % 40 + 11)").alias("ids"))
    places = orders.select("conv_id", "turn", F.posexplode("ids").alias("pos", "doc_id"))
    met = places.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    first = F.min(F.when(F.col("quality") == 1, F.col("pos"))).cast("long")
    return met.groupBy("conv_id", "turn").agg(first.alias("first_relevant"), F.count_if(F.col("quality").isNull()).alias("unjudged"))


@query("""
    SELECT d.doc_id, string_agg(p.page_id::VARCHAR, ',' ORDER BY p.page_id) AS pictures FROM documents d LEFT JOIN pages p ON p.page_id * 7 % 501 = d.doc_id GROUP BY d.doc_id
""")
def jn13_pictures(spark, sf_dir):
    """The pictures of each chunk, if there are any."""
    pictures = table(spark, sf_dir, "pages").select("page_id", F.expr("page_id * 7 % 501").alias("doc_id"))
    found = table(spark, sf_dir, "documents").select("doc_id").join(pictures, "doc_id", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list("page_id")).alias("p"))
    return found.select("doc_id", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x.cast("string")), ",")).alias("pictures"))


@query("WITH " + ENTRIES + """
    , l AS (SELECT page_id, ['E' || (page_id % 60), 'U7', 'E' || (page_id % 44)] AS tokens FROM pages),
    t AS (SELECT page_id, unnest(tokens) AS code_norm, generate_subscripts(tokens, 1) AS pos FROM l)
    SELECT page_id, entry_id FROM t JOIN e USING (code_norm) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos, entry_id) = 1
""")
def jn15_first_token_wins(spark, sf_dir):
    labels = table(spark, sf_dir, "pages").select("page_id", F.expr("concat('E', page_id % 60, '/U7,E', page_id % 44, ' [door]')").alias("label"))
    tokens = labels.select("page_id", F.posexplode(F.regexp_extract_all(F.substring_index("label", "[", 1), F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("pos", "code_norm"))
    least = _entries(spark, sf_dir).groupBy("code_norm").agg(F.min("entry_id").alias("entry_id"))  # the lowest of a code wins in any case
    return tokens.join(least, "code_norm").groupBy("page_id").agg(F.min_by("entry_id", F.struct("pos", "entry_id")).alias("entry_id"))


@query("WITH " + ENTRIES + "SELECT e.code_norm AS code, e.entry_id, s.s_name AS solution FROM e JOIN supplier s ON s.s_suppkey = e.entry_id % 150 WHERE e.code_norm IN ('E1', 'E7', 'E44')")
def jn18_solutions(spark, sf_dir):
    entries = _entries(spark, sf_dir).where(F.col("code_norm").isin("E1", "E7", "E44")).withColumn("s_suppkey", F.expr("entry_id % 150"))
    return entries.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("code_norm").alias("code"), "entry_id", F.col("s_name").alias("solution"))


@query("""
    SELECT m.event_id, n.n_name AS brand, r.r_name AS category, n.n_nationkey IS NULL AS missing FROM (SELECT event_id, user_id % 27 AS manual FROM events) m
    LEFT JOIN nation n ON n.n_nationkey = m.manual LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def jn19_point_lookups(spark, sf_dir):
    """The product of each manual; a manual without a row is marked, as the caller ends with an error there."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("manual"), F.col("n_name").alias("brand"), F.col("r_name").alias("category"))
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 27).cast("int").alias("manual"))
    return asked.join(nation, "manual", "left").select("event_id", "brand", "category", F.col("brand").isNull().alias("missing"))


@query("SELECT kind, value FROM (SELECT DISTINCT 'brand' AS kind, p_brand AS value FROM part UNION SELECT DISTINCT 'feature', p_type FROM part)")
def agg2_distinct_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = lambda kind, column: part.select(F.lit(kind).alias("kind"), F.col(column).alias("value")).distinct()
    return one("brand", "p_brand").union(one("feature", "p_type"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS patterns, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def agg4_pattern_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("patterns"), F.count(F.lit(1)).alias("n"))


@query(VECTORS + "SELECT query_id // 100 AS query_id, id, round(max(1 - distance / 4), 6) AS score FROM near WHERE rank <= 15 GROUP BY ALL")
def agg11_best_scores(spark, sf_dir):
    """The best score of a candidate over sub-queries."""
    found = retrieval.nearest(*_vectors(spark, sf_dir), "label", 15).withColumn("query_id", F.expr("query_id DIV 100"))
    return found.groupBy("query_id", "id").agg(F.round(F.max(1 - F.col("distance") / 4), 6).alias("score"))


@query(VECTORS + """, h AS (SELECT query_id, bool_or(rank <= 3 AND id % 5 = 0) AS sorted_hit, bool_or(id % 5 = 0 AND (rank * 7 + query_id) % 20 < 3) AS shuffled_hit FROM near WHERE rank <= 20 GROUP BY query_id)
    SELECT *, sorted_hit OR shuffled_hit AS union_hit FROM h
""")
def set3_ensemble(spark, sf_dir):
    """A hit of either of two orders of the pool."""
    pool = retrieval.nearest(*_vectors(spark, sf_dir), "label", 20)
    hit = F.col("id") % 5 == 0
    found = pool.groupBy("query_id").agg(F.max(hit & (F.col("rank") <= 3)).alias("sorted_hit"), F.max(hit & ((F.col("rank") * 7 + F.col("query_id")) % 20 < 3)).alias("shuffled_hit"))
    return found.withColumn("union_hit", F.col("sorted_hit") | F.col("shuffled_hit"))


# Routes --------------------------------------------------------------------------------------------------------------
@query(HITS + """, a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value < 2)
    SELECT q.q_id, CASE WHEN q.q_id % 50 = 49 THEN 'unregistered' WHEN q.q_id IN (SELECT q_id FROM hit) THEN 'error_code'
        WHEN contains(q.text, 'without') AND user_id IN (FROM a) THEN 'feature_absent' WHEN user_id % 4 <> 0 THEN 'vector' ELSE 'none' END AS route FROM q
""")
def rte1_service_routes(spark, sf_dir):
    """Each question's route: unregistered products first (RTE-5), then exact codes, features known to be absent, near
    chunks, none."""
    asked, hits = questions(spark, sf_dir), _hits(spark, sf_dir, 1).select("q_id").withColumn("coded", F.lit(True))
    absent = table(spark, sf_dir, "events").where("event_type = 'error' AND value < 2").select("user_id").distinct().withColumn("absent", F.lit(True))
    rows = asked.join(hits, "q_id", "left").join(absent, "user_id", "left")
    route = F.when(F.col("q_id") % 50 == 49, "unregistered").when(F.col("coded"), "error_code").when(F.contains("text", F.lit("without")) & F.col("absent"), "feature_absent")
    return rows.select("q_id", route.when(F.col("user_id") % 4 != 0, "vector").otherwise("none").alias("route"))


@query(HITS + """, n AS (SELECT q_id, count(*) AS entries, string_agg(title, ' / ' ORDER BY place) AS titles FROM hit WHERE place <= 3 GROUP BY q_id)
    SELECT q.q_id, CASE WHEN n.q_id IS NULL THEN CASE WHEN q.q_id % 2 = 0 THEN 'vector_exact' ELSE 'vector_general' END WHEN user_id % 3 = 0 THEN 'rdb' ELSE 'combined' END AS source, titles
    FROM q LEFT JOIN n USING (q_id)
""")
def rte3_answer_sources(spark, sf_dir):
    """Questions with codes are answered from the table alone or together with near chunks; others from chunks."""
    held = F.array_sort(F.collect_list(F.struct("place", "title")))
    wanted = _wanted(spark, sf_dir)
    lists = _lists(wanted, _entries(spark, sf_dir), 3).groupBy("wanted").agg(F.array_join(F.transform(held, lambda x: x["title"]), " / ").alias("titles"))
    titles = wanted.select("q_id", "wanted").join(lists, "wanted").select("q_id", "titles")
    rows = questions(spark, sf_dir).join(titles, "q_id", "left")
    plain = F.when(F.col("q_id") % 2 == 0, "vector_exact").otherwise("vector_general")
    return rows.select("q_id", F.when(F.col("titles").isNull(), plain).when(F.col("user_id") % 3 == 0, "rdb").otherwise("combined").alias("source"), "titles")


@query(VECTORS + """, least AS (SELECT query_id, min(distance) AS least FROM near WHERE rank <= 3 AND id % 4 <> 1 GROUP BY query_id)
    SELECT q.query_id, CASE WHEN least IS NULL THEN 'none' WHEN least < 1.2 OR (least < 1.6 AND q.query_id % 3 = 0) THEN 'answered' ELSE 'declined' END AS outcome FROM q LEFT JOIN least USING (query_id)
""")
def rte4_gate(spark, sf_dir):
    """No candidates: none; else the two-threshold gate on the least distance."""
    queries, chunks = _vectors(spark, sf_dir)
    found = retrieval.nearest(queries, chunks, "label", 3).where("id % 4 <> 1")
    passed = routing.gated(found, F.col("query_id") % 3 == 0, near=1.2, far=1.6).select("query_id", "answered")
    outcome = F.when(F.col("answered").isNull(), "none").when(F.col("answered"), "answered").otherwise("declined")
    return queries.select("query_id").join(passed, "query_id", "left").select("query_id", outcome.alias("outcome"))


@query(r"""
    WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{4,}')) AS tok, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9-]{4,}'), 1) AS pos FROM documents WHERE text IS NOT NULL),
    m AS (SELECT model, min(page_id) AS manual FROM (SELECT page_id, upper(regexp_extract(url, '//([a-z]{5,})', 1)) AS model FROM pages) WHERE model <> '' GROUP BY model)
    SELECT doc_id, manual FROM q JOIN m ON m.model = replace(upper(tok), '-', '') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1
""")
def rte6_manual_of_question(spark, sf_dir):
    """The manual of the first token that names a model, hyphens aside."""
    model = F.upper(F.regexp_extract("url", "//([a-z]{5,})", 1))
    known = table(spark, sf_dir, "pages").select(model.alias("model"), "page_id").where("model <> ''").groupBy("model").agg(F.min("page_id").alias("manual"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    tokens = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9-]{4,}"), F.lit(0))).alias("pos", "token"))
    first = tokens.select("doc_id", F.replace(F.upper("token"), F.lit("-"), F.lit("")).alias("model"), "pos").groupBy("doc_id", "model").agg(F.min("pos").alias("pos"))
    return first.join(known, "model").groupBy("doc_id").agg(F.min_by("manual", "pos").alias("manual"))


@query("""
    WITH k AS (SELECT DISTINCT s_name AS model FROM supplier UNION SELECT DISTINCT substring(s_name, 1, 17) FROM supplier),
    a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'lg_Supplier#0000000' || (c_custkey % 100) WHEN 1 THEN 'Supplier#00000000' || (c_custkey % 10) ELSE 'none' || c_custkey END AS manual FROM customer)
    SELECT c_custkey, model FROM a LEFT JOIN k ON contains(manual, model) OR contains(model, manual) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY manual = model DESC, length(model) DESC, model) = 1
""")
def rte7_partial_models(spark, sf_dir):
    """The known model that is part of a manual's name or the other way round: an equal one, else the longest. Either
    way the longer one's substrings meet the shorter ones by equality."""
    suppliers = table(spark, sf_dir, "supplier")
    known = suppliers.select(F.col("s_name").alias("model")).union(suppliers.select(F.substring("s_name", 1, 17))).distinct()
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('lg_Supplier#0000000', c_custkey % 100) WHEN 1 THEN concat('Supplier#00000000', c_custkey % 10) ELSE concat('none', c_custkey) END")
    asked = table(spark, sf_dir, "customer").select("c_custkey", name.alias("manual"))
    met = tables.containing(asked, "manual", known, "model").unionByName(tables.containing(known, "model", asked, "manual")).distinct()
    best = met.groupBy("manual").agg(F.min_by("model", F.struct(F.col("manual") != F.col("model"), -F.length("model"), "model")).alias("model"))
    return asked.join(best, "manual", "left").select("c_custkey", "model")


@query(HITS + "SELECT q_id, CASE WHEN entry_id % 4 = 0 THEN 'rdb_error_' || entry_id ELSE 'chunk_' || entry_id END AS id, kind || ' > ' || title || chr(10) || entry_id AS text FROM hit")
def rte8_rendered_entries(spark, sf_dir):
    """Code entries as chunks; an entry without a chunk of its own is named after the entry."""
    chunk = F.when(F.col("entry_id") % 4 != 0, F.concat(F.lit("chunk_"), "entry_id"))
    text = F.concat("kind", F.lit(" > "), "title", F.lit("\n"), "entry_id")
    return _hits(spark, sf_dir).select("q_id", F.coalesce(chunk, F.concat(F.lit("rdb_error_"), "entry_id")).alias("id"), text.alias("text"))


@query(VECTORS + """SELECT n.query_id, n.id, substring(d.text, 1, 220) AS snippet, round(n.distance, 3) AS distance FROM near n JOIN documents d ON d.doc_id = n.id WHERE n.rank <= 3 AND d.text IS NOT NULL""")
def rte9_source_rows(spark, sf_dir):
    """Snippets are cut before they meet the hits, so that whole texts are read but not shuffled."""
    found = retrieval.nearest(*_vectors(spark, sf_dir), "label", 3)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.substring("text", 1, routing.SNIPPET).alias("text"))
    return routing.source_rows(found.join(docs, "id"), "text").select("query_id", "id", "snippet", "distance")


# Sinks ---------------------------------------------------------------------------------------------------------------
@query("""
    SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS copied, (SELECT max(c_custkey) + 1 FROM customer) AS next_id
    UNION ALL SELECT 'orders', 0, (SELECT max(o_orderkey) + 1 FROM orders WHERE o_orderkey % 2 = 0)
""")
def snk3_reloaded(spark, sf_dir):
    """What a reload does: an empty table is filled, one with rows is left alone; its sequence goes on after the greatest id."""

    def loaded(name, rows, held, key):
        after = rows if held.isEmpty() else held
        copied = F.count(F.lit(1)) if held.isEmpty() else F.lit(0).cast("long")
        return after.agg(copied.alias("copied"), (F.max(key) + 1).alias("next_id")).select(F.lit(name).alias("name"), "copied", "next_id")

    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return loaded("customer", customer, customer.where("c_custkey < 0"), "c_custkey").union(loaded("orders", orders, orders.where("o_orderkey % 2 = 0"), "o_orderkey"))


@query("""
    WITH gone AS (SELECT user_id FROM events WHERE event_type = 'signup' AND value < 3), kept AS (SELECT * FROM events WHERE user_id NOT IN (FROM gone))
    SELECT user_id, count(*) AS messages, max(event_id) AS last_message, max(CASE WHEN event_type = 'view' THEN 'patched' ELSE event_type END) AS name FROM kept GROUP BY user_id
""")
def snk8_cascade(spark, sf_dir):
    """Deletes users with all that hangs on them, patches a column, and sets each one's last change from its messages."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    gone = events.where("event_type = 'signup' AND value < 3").select("user_id").distinct()
    kept = events.join(gone, "user_id", "left_anti").withColumn("name", F.when(F.col("event_type") == "view", "patched").otherwise(F.col("event_type")))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.max("event_id").alias("last_message"), F.max("name").alias("name"))
