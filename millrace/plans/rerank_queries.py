"""Re-ranking by given replies and scores, carried splits, page assignment over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunking, page_index, retrieval, toc
from millrace.operators.stored import stored
from millrace.plans.registry import query, table
from millrace.plans.retrieval_queries import VECTORS, _vectors
from millrace.plans.structure_queries import TOC, _toc


@query(VECTORS + r"""
    , h AS (SELECT query_id, list(id ORDER BY rank) AS held FROM near WHERE rank <= 12 GROUP BY query_id),
    r AS (SELECT h.*, CASE WHEN query_id % 40 = 0 THEN '3, 1, 99 and 1 then 7' ELSE 'none' END AS reply FROM h),
    o AS (SELECT query_id, held, unnest(CASE WHEN len(held) > 5 AND reply <> 'none' THEN list_filter([3, 1, 7], lambda x: x < len(held)) ELSE range(0, least(5, len(held)))::INT[] END) AS i,
        generate_subscripts(CASE WHEN len(held) > 5 AND reply <> 'none' THEN list_filter([3, 1, 7], lambda x: x < len(held)) ELSE range(0, least(5, len(held)))::INT[] END, 1) AS place FROM r)
    SELECT query_id, held[i + 1] AS id, place::BIGINT AS place FROM o
""")
def vec5_listwise(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = retrieval.nearest(queries, chunks, "label", 12)
    replies = queries.select("query_id", F.when(F.col("query_id") % 40 == 0, "3, 1, 99 and 1 then 7").otherwise("none").alias("reply"))
    return retrieval.reranked(near, replies, 12, 5).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query(VECTORS + """
    SELECT query_id, id, round(1 - 1 / (1 + id % 97), 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY 1 - 1.0::DOUBLE / (1 + id % 97), id) AS place
    FROM near WHERE rank <= 20 QUALIFY place <= 5
""")
def vec4_pointwise(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    near = stored(retrieval.nearest(queries, chunks, "label", 20).select("query_id", "id"), "near")
    scores = near.select("query_id", "id", (1.0 / (1 + F.col("id") % 97)).alias("p"))
    found = retrieval.pointwise(near, scores, 5)
    return found.select("query_id", "id", F.round("distance", 9).alias("distance"), F.col("place").cast("long").alias("place"))


@query(r"""
    WITH RECURSIVE lines AS (
        SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
    ), walk(doc_id, n, piece_no, open, size) AS (
        SELECT doc_id, 1, 0, l[1:1], length(l[1]) + 1 FROM lines
        UNION ALL
        SELECT doc_id, n + 1, CASE WHEN fits THEN piece_no ELSE piece_no + 1 END, CASE WHEN fits THEN open || [x] ELSE kept || [x] END,
            CASE WHEN fits THEN size ELSE coalesce(list_sum(list_transform(kept, lambda y: length(y) + 1)), 0) END + length(x) + 1
        FROM (SELECT *, size + length(x) + 1 <= 1200 AS fits, list_filter(open, lambda y, i: list_sum(list_transform(open[i:], lambda z: length(z) + 1)) <= 101) AS kept
              FROM (SELECT w.*, l[n + 1] AS x FROM walk w JOIN lines USING (doc_id) WHERE n < len(l)))
    )
    SELECT doc_id, CAST(piece_no AS INT) AS piece_no, md5(array_to_string(arg_max(open, n), chr(10))) AS piece_md5 FROM walk GROUP BY doc_id, piece_no
""")
def chk1f_split_with_carry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(chunking.split_with_carry(F.split("text", "\n"))).alias("piece_no", "piece")).select("doc_id", "piece_no", F.md5("piece").alias("piece_md5"))


@query(r"""
    WITH p AS (SELECT doc_id, n AS page, regexp_replace(substring(text, n * 900 + 1, 900), '\s+', '', 'g') AS bare FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 899) // 900))) AS n FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT doc_id, n AS piece_no, regexp_replace(substring(text, n * 595 + 1, 700), '\s+', '', 'g') AS b FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(length(text) - 1, 0) // 595)) AS n FROM documents WHERE text IS NOT NULL)),
    t AS (SELECT c.*, i, CASE WHEN i <= 3 THEN substring(b, 1, [120, 80, 40, 20][i + 1]) ELSE substring(b, [30, 60, 90][i - 3] + 1, 30) END AS probe FROM c, (SELECT unnest(range(7)) AS i)),
    m AS (SELECT t.doc_id, t.piece_no, min(i * 1000000 + page) % 1000000 AS page_start FROM t JOIN p ON p.doc_id = t.doc_id AND probe <> '' AND contains(bare, probe) GROUP BY ALL),
    e AS (SELECT m.*, i, CASE WHEN length(b) <= n THEN b ELSE right(b, n) END AS probe FROM m JOIN c USING (doc_id, piece_no), (SELECT unnest(range(4)) AS i, unnest([120, 80, 40, 20]) AS n)),
    f AS (SELECT e.doc_id, e.piece_no, min(i * 1000000 + page) % 1000000 AS page_end FROM e JOIN p ON p.doc_id = e.doc_id AND page >= page_start AND contains(bare, probe) GROUP BY ALL)
    SELECT c.doc_id, CAST(c.piece_no AS INT) AS piece_no, CAST(page_start AS INT) AS page_start, CAST(coalesce(page_end, page_start) AS INT) AS page_end FROM c LEFT JOIN m USING (doc_id, piece_no) LEFT JOIN f USING (doc_id, piece_no)
""")
def chk18_page_assignment(spark, sf_dir):
    """Pages on which a piece begins and ends, by its longest findable start and end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = chunking.sliding(docs, size=900, step=900).select("doc_id", F.col("piece_no").alias("page"), F.col("piece").alias("text"))
    pieces = chunking.sliding(docs).select("doc_id", "piece_no", "piece")
    return page_index.assigned_pages(pieces, pages, ["doc_id"], "piece")


@query(TOC + """
    SELECT p.doc_id, p.seq, md5('[' || array_to_string(list_filter([g.title, q.title, p.title], lambda x: x IS NOT NULL), ' > ') || '] ' || p.title) AS piece_md5
    FROM p LEFT JOIN p q ON q.doc_id = p.doc_id AND q.seq = p.parent_seq LEFT JOIN p g ON g.doc_id = q.doc_id AND g.seq = q.parent_seq WHERE p.leaf
""")
def chk1e_breadcrumbs(spark, sf_dir):
    """Sections without sections below them, each behind the path of titles that leads to it."""
    rows = toc.with_parents(_toc(spark, sf_dir), "doc_id", 3)
    named = rows.select("doc_id", F.col("seq").alias("parent_seq"), F.col("title").alias("above"), F.col("parent_seq").alias("upper_seq"))
    upper = named.select("doc_id", F.col("parent_seq").alias("upper_seq"), F.col("above").alias("top"))
    found = rows.where("leaf").join(named, ["doc_id", "parent_seq"], "left").join(upper, ["doc_id", "upper_seq"], "left")
    found = found.withColumn("ancestors", F.filter(F.array("top", "above"), lambda x: x.isNotNull())).withColumn("piece", F.col("title"))
    return chunking.with_breadcrumbs(found, "ancestors", "title", "piece").select("doc_id", "seq", F.md5("piece").alias("piece_md5"))
