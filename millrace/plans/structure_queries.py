"""Tables of contents, code titles, range joins and further aggregations over the given tables.

A document's lines stand for its table of contents: short lines are upper levels, line numbers are pages.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, retrieval, toc
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import VECTORS, _vectors

TOC = """
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
        FROM documents WHERE text IS NOT NULL
    ), t AS (
        SELECT doc_id, CAST(n AS INT) AS seq, CASE WHEN length(line) < 30 THEN 1 WHEN length(line) < 90 THEN 2 ELSE 3 END AS level,
            line AS title, CAST(n + 1 AS INT) AS page
        FROM l
    ), p AS (
        SELECT *, CASE WHEN level = 2 THEN l1 WHEN level = 3 THEN greatest(l1, l2) END AS parent_seq,
            coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY seq) <= level, true) AS leaf
        FROM (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER w AS l1, max(CASE WHEN level = 2 THEN seq END) OVER w AS l2
              FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    )
"""


def _toc(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    size = F.length("line")
    return rows.select(
        "doc_id",
        F.col("line_no").alias("seq"),
        F.when(size < 30, 1).when(size < 90, 2).otherwise(3).alias("level"),
        F.col("line").alias("title"),
        (F.col("line_no") + 1).alias("page"),
    )


@query(TOC + "SELECT doc_id, seq, level, parent_seq, leaf FROM p")
def chk2_parents(spark, sf_dir):
    return toc.with_parents(_toc(spark, sf_dir), "doc_id", 3).select("doc_id", "seq", "level", "parent_seq", "leaf")


@query(TOC + """
    , f AS (
        SELECT *, coalesce(max(CASE WHEN level = 1 AND contains(lower(title), 'the') THEN seq END) OVER w = max(CASE WHEN level = 1 THEN seq END) OVER w, false) AS forced
        FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
    SELECT doc_id, seq, level, forced FROM f WHERE CASE WHEN forced THEN leaf ELSE level = 2 OR (leaf AND level < 2) END
""")
def chk3_boundaries(spark, sf_dir):
    found = toc.boundaries(_toc(spark, sf_dir), "doc_id", 3, F.contains(F.lower("title"), F.lit("the")))
    return found.select("doc_id", "seq", "level", "forced")


@query(TOC + """
    , s AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last_page FROM p),
    e AS (SELECT doc_id, seq, page, greatest(coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY seq), last_page + 1), page + 1) AS page_end FROM s WHERE level <= 2)
    SELECT doc_id, seq, page, CASE WHEN page_end - page > 20 THEN page + 1 ELSE page_end END AS page_end FROM e
""")
def chk4_page_spans(spark, sf_dir):
    rows = _toc(spark, sf_dir).withColumn("last_page", F.max("page").over(Window.partitionBy("doc_id")))
    return toc.spans(rows.where("level <= 2"), "doc_id", "last_page", 20).select("doc_id", "seq", "page", "page_end")


@query(TOC + """
    , one AS (
        SELECT p.doc_id, p.seq, p.title, CASE WHEN dup > 1 AND q.title IS NOT NULL THEN '[' || q.title || '] ' || p.title ELSE p.title END AS heading,
            CASE WHEN dup > 1 AND q.title IS NOT NULL THEN q.parent_seq END AS up
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, title) AS dup FROM p) p LEFT JOIN p q ON q.doc_id = p.doc_id AND q.seq = p.parent_seq
    )
    SELECT o.doc_id, o.seq, CASE WHEN dup > 1 AND q.title IS NOT NULL THEN '[' || q.title || '] ' || heading ELSE heading END AS heading
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, heading) AS dup FROM one) o LEFT JOIN p q ON q.doc_id = o.doc_id AND q.seq = o.up
""")
def chk7_unique_titles(spark, sf_dir):
    return toc.unique_titles(_toc(spark, sf_dir), "doc_id", 3).select("doc_id", "seq", "heading")


TITLES = """
    t AS (
        SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || ' / ' || p_type || ' (' || p_size || ' mm) '
            WHEN 1 THEN 'Er(E) F' || (p_size % 10) || ', CH0' || p_size || ' (' || p_name || ')' WHEN 2 THEN p_name
            WHEN 3 THEN 'E ' || p_size || '/ ' || p_type || ',U' || p_size || 'x' ELSE ' (' || p_name || ') ' || p_size END AS title
        FROM part
    )
"""


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        """CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, ' / ', p_type, ' (', p_size, ' mm) ')
        WHEN 1 THEN concat('Er(E) F', p_size % 10, ', CH0', p_size, ' (', p_name, ')') WHEN 2 THEN p_name
        WHEN 3 THEN concat('E ', p_size, '/ ', p_type, ',U', p_size, 'x') ELSE concat(' (', p_name, ') ', p_size) END AS title""",
    )


@query("WITH " + TITLES + r"""
    , s AS (SELECT p_partkey, trim(title) AS title, regexp_extract(trim(title), '^(.*?)\s*\(([^()]*)\)\s*$', ['name', 'summary']) AS m FROM t)
    SELECT p_partkey, CASE WHEN m.name <> '' OR m.summary <> '' THEN trim(m.name) ELSE title END AS name, trim(m.summary) AS summary FROM s
""")
def fn4_split_titles(spark, sf_dir):
    rows = _titles(spark, sf_dir).select("p_partkey", T.split_title(T.stripped(F.col("title"))).alias("t"))
    return rows.select("p_partkey", "t.name", "t.summary")


@query("WITH " + TITLES + r"""
    , s AS (SELECT p_partkey, trim(title) AS title, regexp_extract(trim(title), '^(.*?)\s*\(([^()]*)\)\s*$', ['name', 'summary']) AS m FROM t),
    n AS (SELECT p_partkey, CASE WHEN m.name <> '' OR m.summary <> '' THEN trim(m.name) ELSE title END AS name FROM s),
    p AS (SELECT p_partkey, unnest(string_split_regex(name, '\s*[/,]\s*')) AS part, generate_subscripts(string_split_regex(name, '\s*[/,]\s*'), 1) AS i FROM n),
    a AS (SELECT p_partkey, i, trim(part) AS part, regexp_extract(part, '(\w+)\((\w+)\)', ['one', 'two']) AS m, regexp_extract(part, '(\w+)\((\w+)\)') AS w FROM p),
    e AS (SELECT p_partkey, i, j, CASE WHEN w = '' THEN part WHEN j = 1 THEN replace(part, w, m.one) ELSE replace(part, w, m.two) END AS alt
          FROM a, (SELECT unnest([1, 2]) AS j) WHERE j = 1 OR w <> ''),
    k AS (SELECT *, regexp_extract(trim(alt), '^(Er|E)\s+([A-Za-z0-9]{1,4})$', 2) AS alone FROM e),
    c AS (SELECT p_partkey, i, j, l, CASE WHEN alone = '' THEN trim(alt) WHEN l = 1 THEN replace(trim(alt), ' ', '') ELSE alone END AS code
          FROM k, (SELECT unnest([1, 2]) AS l) WHERE l = 1 OR alone <> ''),
    g AS (SELECT *, upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) AS u FROM c
          WHERE regexp_full_match(replace(code, ' ', ''), '[A-Za-z]{0,3}\d{0,3}[A-Za-z]{0,3}') AND regexp_full_match(code, '[A-Za-z0-9 ]+')),
    f AS (SELECT p_partkey, regexp_replace(u, '^([A-Z]*)0+([0-9]+[A-Z]*)$', '\1\2') AS code, min(i * 100 + j * 10 + l) AS seen FROM g WHERE u <> '' GROUP BY ALL)
    SELECT n.p_partkey, coalesce(string_agg(code, ',' ORDER BY seen), '') AS codes FROM n LEFT JOIN f USING (p_partkey) GROUP BY ALL
""")
def fn6_parsed_codes(spark, sf_dir):
    rows = _titles(spark, sf_dir).select("p_partkey", T.parsed_codes(T.split_title(T.stripped(F.col("title")))["name"]).alias("codes"))
    return rows.select("p_partkey", F.array_join("codes", ",").alias("codes"))


@query("""
    WITH d AS (SELECT DISTINCT p_brand, p_type FROM part)
    SELECT a.p_brand, count(DISTINCT b.p_brand) AS n, string_agg(DISTINCT b.p_brand, ',' ORDER BY b.p_brand) AS aliases
    FROM d a JOIN d b ON a.p_type = b.p_type GROUP BY a.p_brand
""")
def jn2_aliases(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    both = pairs.join(pairs.select("p_type", F.col("p_brand").alias("other")), "p_type")
    return both.groupBy("p_brand").agg(F.count_distinct("other").alias("n"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("aliases"))


@query("""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL
    ), o AS (
        SELECT doc_id, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start FROM l
    ), c AS (SELECT doc_id, p AS start, p // 595 AS piece_no FROM (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 595)) AS p FROM documents WHERE text IS NOT NULL))
    SELECT c.doc_id, CAST(c.piece_no AS INT) AS piece_no, CAST(min(o.line_no) AS INT) AS first_line, count(*) AS n_lines
    FROM c JOIN o ON o.doc_id = c.doc_id AND o.start >= c.start AND o.start < c.start + 700 GROUP BY ALL
""")
def jn12_chunk_lines(spark, sf_dir):
    """Lines of pieces: a line's start names the pieces that cover it, so lines and pieces need no join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunking.lines(docs.withColumn("size", F.greatest(F.length("text"), F.lit(1)))).select("doc_id", "size", "line_no", F.length("line").alias("n"))
    starts = rows.withColumn("at", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    first, last = F.expr("greatest(0, (at - 700) DIV 595 + CASE WHEN at >= 700 THEN 1 ELSE 0 END)"), F.expr("at DIV 595")
    covered = starts.select("doc_id", "size", "line_no", F.explode(F.sequence(first, last)).alias("piece_no")).where("piece_no * 595 < size")
    return covered.groupBy("doc_id", F.col("piece_no").cast("int").alias("piece_no")).agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))


@query("""
    SELECT c_custkey, o_orderkey, count(*) AS messages, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 20 GROUP BY c_custkey, o_orderkey, o_orderdate
""")
def jn14_conversations(spark, sf_dir):
    """Each user's conversations about registered products, the newest first, without those that have no messages."""
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")
    messages = table(spark, sf_dir, "lineitem").where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("messages"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    rows = orders.join(messages, "o_orderkey").join(users.select("c_custkey"), "c_custkey")
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long")
    return rows.select("c_custkey", "o_orderkey", "messages", place.alias("place"))


@query(r"""
    WITH k AS (SELECT item_id, lower(regexp_extract(text, '([A-Za-z]{6,})', 1)) AS keyword FROM benchmark),
    w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents WHERE text IS NOT NULL)
    SELECT item_id, keyword, count(w.doc_id) AS hits FROM k LEFT JOIN w ON w.word = k.keyword WHERE keyword <> '' GROUP BY item_id, keyword
""")
def evl7_keyword_hits(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.regexp_extract("text", "([A-Za-z]{6,})", 1)).alias("keyword")).where("keyword != ''")
    words = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = words.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)))).alias("keyword"))
    counts = words.join(keys.select("keyword").distinct(), "keyword", "left_semi").groupBy("keyword").agg(F.count(F.lit(1)).alias("hits"))
    return keys.join(counts, "keyword", "left").select("item_id", "keyword", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("""
    WITH l AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, n // 20 AS size, sum(n)::BIGINT AS weight FROM l GROUP BY ALL)
    SELECT doc_id, arg_max(size, weight * 100000 + size)::BIGINT AS body_size FROM s GROUP BY doc_id
""")
def agg12_body_size(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length("line").alias("n"))
    sizes = rows.groupBy("doc_id", F.floor(F.col("n") / 20).alias("size")).agg(F.sum("n").alias("weight"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("weight", "size")).alias("body_size"))


@query(VECTORS + """, other AS (SELECT query_id, id, distance * 1.5 AS distance FROM near WHERE rank <= 20)
    SELECT query_id, id, round(min(distance), 6) AS distance FROM (
        SELECT query_id, id, distance FROM near WHERE rank BETWEEN 10 AND 15 UNION ALL SELECT * FROM other) GROUP BY query_id, id
""")
def agg10_least_distances(spark, sf_dir):
    """Candidates of two searches, the second at half as much again; the first is part of the second, so one search runs."""
    queries, chunks = _vectors(spark, sf_dir)
    far = F.col("distance") * 1.5
    found = F.when(F.col("rank").between(10, 15), F.array("distance", far)).otherwise(F.array(far))
    both = retrieval.nearest(queries, chunks, "label", 20).select("query_id", "id", F.explode(found).alias("distance"))
    return retrieval.least_distance(both).select("query_id", "id", F.round("distance", 6).alias("distance"))


@query("SELECT lang, string_agg(doc_id::VARCHAR, ',' ORDER BY n_chars DESC, doc_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10 GROUP BY lang")
def agg22_ordered_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id"))
    top = docs.withColumn("n", nth).where("n <= 10")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    return top.groupBy("lang").agg(F.array_join(listed, ",").alias("ids"))


@query("""
    SELECT quality AS old_label, CASE WHEN n_chars >= 1000 AND toxic = 0 THEN 1 ELSE 0 END AS new_label, count(*) AS n
    FROM labels JOIN documents USING (doc_id) GROUP BY ALL
""")
def evl19_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    new = F.when((F.col("n_chars") >= 1000) & (F.col("toxic") == 0), 1).otherwise(0)
    return rows.groupBy(F.col("quality").alias("old_label"), new.alias("new_label")).agg(F.count(F.lit(1)).alias("n"))


REPLIES = """
    WITH r AS (
        SELECT event_id, event_type AS asked, CASE event_id % 4
            WHEN 0 THEN 'Sure: ["' || event_type || ' ", ' || user_id || ', "u' || user_id || '", ""] done' WHEN 1 THEN 'no list for ' || user_id
            WHEN 2 THEN '["' || event_type || '", oops]' ELSE '[' || user_id || ', ' || event_id || ']' END AS reply
        FROM events
    )
"""


@query(REPLIES + """
    , m AS (SELECT *, regexp_extract(reply, '(?s)\\[.*\\]') AS found FROM r),
    s AS (SELECT *, CASE WHEN json_valid(found) THEN list_filter(list_transform(list_filter(json_extract(found, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(x->>'$')), lambda x: x <> '') END AS parts FROM m)
    SELECT event_id, array_to_string(CASE WHEN len(parts) > 0 THEN parts ELSE [asked] END, '|') AS parts FROM s
""")
def fn25_strings_from_replies(spark, sf_dir):
    """The strings of a JSON array inside a reply; the question itself where there is none."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_type AS asked",
        """CASE event_id % 4 WHEN 0 THEN concat('Sure: ["', event_type, ' ", ', user_id, ', "u', user_id, '", ""] done')
        WHEN 1 THEN concat('no list for ', user_id) WHEN 2 THEN concat('["', event_type, '", oops]') ELSE concat('[', user_id, ', ', event_id, ']') END AS reply""",
    )
    return rows.select("event_id", F.array_join(T.strings_from(F.col("reply"), F.col("asked")), "|").alias("parts"))
