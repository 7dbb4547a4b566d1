"""The registered queries of this subpackage, opN_<name>, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat_repair, exact_dedup, jaccard_join, mixing, pii, prefix_trie, spelling_groups, suffix_dedup, telephony, token_files, topk_slices, toxicity
from millrace.llm.common import table, written

def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, which is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read_digests(manifest)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repaired(table(spark, sf_dir, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(telephony.stored(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return telephony.decoded_features(media)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, toxicity.held_out_fold())
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(toxicity.held_out_fold(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op11_topk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_slices.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_suffix_dedup, op3_chat_repair, op4_exact_dedup, op5_telephony, op6_jaccard_join, op7_mixing, op8_toxicity, op9_pii, op10_bpe, op11_topk_slices, op12_spelling_groups, op13_prefix_trie)
}

#: crc32 of a string {0} of code points up to 255, bit by bit, as an expression.
CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(flatten(list_transform(string_split({0}, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)),
    lambda b: list_transform(range(8), lambda k: ((b >> k::INT) & 1)::BIGINT))),
    lambda r, bit: xor(r >> 1, 3988292384::BIGINT * (xor(r, bit) & 1))), 4294967295::BIGINT)"""

ORACLES = {
    "op11_topk_slices": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
        QUALIFY rank <= 10
    """,
    "op12_spelling_groups": r"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), hashed AS (
            SELECT run, """ + CRC.format("concat(doc_id, ':', run)") + r""" AS h FROM runs WHERE length(run) >= 7
        ), words AS (
            SELECT word, count(*) AS n FROM (
                SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
            ) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
        ), cut AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
        ), parts AS (
            SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS less, i FROM cut
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM parts a JOIN parts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM parts a JOIN words b ON a.less = b.word
            UNION SELECT b.word, a.word, a.n FROM parts a JOIN words b ON a.less = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
        ), forms AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
                CASE WHEN b.most >= 10 * w.n THEN (SELECT min(encode(x.other)) FROM near x WHERE x.word = w.word AND x.n = b.most) END AS form,
                CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word
        ), chain(word, last, step) AS (
            SELECT word, word, 0 FROM words UNION ALL
            SELECT chain.word, decode(f.form), step + 1 FROM chain JOIN forms f ON f.word = chain.last WHERE f.form IS NOT NULL
        )
        SELECT f.word, decode(f.form) AS form, (SELECT arg_max(last, step) FROM chain WHERE chain.word = f.word) AS root,
            f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f
    """,
    "op13_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
                ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, """ + CRC.format("conv_id::VARCHAR") + """ % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
        ), placed AS (
            SELECT c.conv_id, 0 AS own, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
            UNION ALL SELECT c.conv_id, 1, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h
        ), paths AS (
            SELECT c.conv_id, coalesce(list(md5(concat(strlen(role), ':', role, text)) ORDER BY own, i) FILTER (i IS NOT NULL), []) AS path,
                coalesce(list(strlen(text) ORDER BY own, i) FILTER (i IS NOT NULL), []) AS sizes
            FROM convs c LEFT JOIN placed p USING (conv_id) GROUP BY c.conv_id
        ), depths AS (
            SELECT conv_id, path, sizes, unnest(range(len(path) + 1)) AS d FROM paths
        ), members AS (
            SELECT conv_id, d, array_to_string(path[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS up,
                CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(path) AS ends FROM depths
        ), nodes AS (
            SELECT node, d, up, size, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY node, d, up, size
        ), kids AS (
            SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), full_nodes AS (
            SELECT a.*, coalesce(k.n, 0) AS n_children FROM nodes a LEFT JOIN kids k ON k.up = a.node
        ), above AS (
            SELECT left(node, (k * 32)::INT) AS top, n_children, (n_convs - 1) * size AS saved
            FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_nodes)
        ), sums AS (
            SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY top
        )
        SELECT a.conv_id, a.d::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
        FROM full_nodes a LEFT JOIN nodes p ON p.node = a.up AND p.d = a.d - 1 JOIN sums s ON s.top = a.node
    """,
    "op4_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM rows WINDOW g AS (PARTITION BY norm)
    """,
    "op6_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words
        ), shingles AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT sets.doc_id, len(s) AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id FROM sets
    """,
    "op7_mixing": r"""
        WITH sizes AS (
            SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key,
                coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
        ), sums AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
        ), ranked AS (
            SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) AS nth FROM sums
        ), weighted AS (
            SELECT *, nth % 3 + 1 AS weight, source_size * 3 AS cap FROM ranked
        ), ordered AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS rest,
                sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
            FROM weighted WINDOW w AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), level AS (
            SELECT rest, open FROM ordered WHERE cap * open > rest * weight ORDER BY cap / weight, nth LIMIT 1
        ), targets AS (
            SELECT source, source_size, CASE WHEN cap * ordered.open <= ordered.rest * weight THEN cap::DOUBLE
                ELSE (level.rest * weight)::DOUBLE / level.open::DOUBLE END AS target
            FROM ordered LEFT JOIN level ON true
        ), drawn AS (
            SELECT doc_id, size, source_size, target,
                CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                ('0x' || substr(md5('millrace-mix:' || key), 1, 13))::BIGINT / 4503599627370496.0 AS draw
            FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, size, source_size, target,
            (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM drawn
    """,
}
