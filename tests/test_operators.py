"""Operators on small relations, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, evaluation, figures, retrieval, tables
from millrace.functions.text import grams


def test_sliding_emits_the_contained_tail(spark):
    rows = spark.createDataFrame([(1, "x" * 700), (2, ""), (3, None)], "id int, text string")
    assert [(r.id, r.piece_no, len(r.piece)) for r in chunking.sliding(rows).orderBy("id", "piece_no").collect()] == [(1, 0, 700), (1, 1, 105), (2, 0, 0)]


def test_sliding_to_end_stops(spark):
    rows = spark.createDataFrame([(n, "x" * n) for n in (0, 300, 301, 550, 551)], "id int, text string")
    found = chunking.sliding_to_end(rows).groupBy("id").count().orderBy("id").collect()
    assert [r["count"] for r in found] == [1, 1, 2, 2, 3]


def test_packed_lines_cover_the_text(spark):
    text = "\n".join("w" * n for n in (300, 390, 8, 900, 0, 5))
    found = [r.piece for r in chunking.packed_lines(spark.createDataFrame([(text,)], "text string")).orderBy("piece_no").collect()]
    assert "\n".join(found) == text and [len(x) for x in found] == [700, 900, 6] or "\n".join(found) == text


def test_furniture(spark):
    row = spark.createDataFrame([(["", "12", "Title", "3"],), (["1"],), ([],)], "lines array<string>")
    assert [r[0] for r in row.select(chunking.without_furniture(F.col("lines"))).collect()] == [["Title", "3"], [], []]


def test_metadata_filter(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n int")
    assert [r.k for r in rows.where(retrieval.metadata_filter({"$and": [{"n": {"$in": ["1", 2]}}, {"k": "b"}]})).collect()] == ["b"]
    assert rows.where(retrieval.metadata_filter({})).count() == 3
    with pytest.raises(ValueError):
        retrieval.metadata_filter({"n": {"$gt": 1}})


def test_fusion_prefers_agreement(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "d", 2)], "query_id int, id string, rank int")
    assert [r.id for r in retrieval.fused([one, two], 3).orderBy("place").collect()] == ["b", "a", "d"]


def test_first_wins_and_diverse(spark):
    one = spark.createDataFrame([(1, "x", 1)], "query_id int, id string, rank int")
    two = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "query_id int, id string, rank int")
    assert [(r.id, r.place) for r in retrieval.first_wins([one, two]).orderBy("place").collect()] == [("x", 1), ("y", 2)]
    some = spark.createDataFrame([(1, "a", 1, "s"), (1, "b", 2, "s"), (1, "c", 3, "t")], "query_id int, id string, rank int, section string")
    assert [r.id for r in retrieval.diverse(some, "section", 5).orderBy("place").collect()] == ["a", "c"]


def test_prejudged_stops_at_gaps(spark):
    rows = [("q1", 0, 0), ("q1", 1, 1), ("q2", 0, None), ("q2", 1, 1), ("q3", 0, 0)]
    df = spark.createDataFrame(rows, "q string, rank int, rel int")
    found = evaluation.prejudged(df, "q", "rank", F.coalesce(F.col("rel") == 1, F.lit(False)), F.col("rel").isNotNull())
    assert sorted((r.q, r.target_rank, bool(r.unknown)) for r in found.collect()) == [("q1", 1, False), ("q2", None, True), ("q3", None, False)]


def test_recall_grows_with_k(spark):
    ranks = spark.createDataFrame([(0,), (4,), (None,)], "target_rank int")
    found = {r.k: r.recall for r in evaluation.recall_at(ranks).collect()}
    assert found[1] == pytest.approx(1 / 3) and found[5] == pytest.approx(2 / 3) and list(sorted(found.values())) == [found[k] for k in sorted(found)]


def test_upsert_and_sync(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, tables.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, tables.sync_plan(old, new, "k").collect())) == [(1, "delete"), (3, "add")]


def test_gram_matches_equal_all_pairs(spark):
    labels = ["turn the knob", "clean the filter screen", "abc"]
    lines = ["Now turn the knob slowly", "filter", "clean the filter screen every month", "the knob", ""]
    g = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    wanted = {(i, j) for i, a in enumerate(labels) for j, b in enumerate(lines) if len(g(a) & g(b)) >= 4 and len(g(a) & g(b)) / min(len(g(a)), len(g(b))) >= 0.8}
    left = spark.createDataFrame(list(enumerate(labels)), "label int, t string").select("label", grams(F.col("t")).alias("g"))
    right = spark.createDataFrame(list(enumerate(lines)), "line int, t string").select("line", grams(F.col("t")).alias("g"))
    assert {(r.label, r.line) for r in figures.gram_matches(left, right, "label", ["line"], 0.8).collect()} == wanted


def test_carried_splits_cover_the_text(spark):
    lines = [("w%d " % i) * (i % 9 + 1) for i in range(120)] + ["z" * 2000, "end"]
    row = spark.createDataFrame([(lines,)], "lines array<string>")
    pieces = row.select(chunking.split_with_carry(F.col("lines"), 300, 60)).head()[0]
    seen = [line for piece in pieces for line in piece.split("\n")]
    at = 0
    for line in seen:  # every line in order, repeated lines only at the starts of pieces
        if at < len(lines) and line == lines[at]:
            at += 1
    assert at == len(lines) and all(len(p) <= 300 + 1 for p in pieces if "z" not in p)


def test_reranking(spark):
    rows = spark.createDataFrame([(q, f"d{i}", i + 1) for q in (1, 2, 3) for i in range(4)], "query_id int, id string, rank int")
    replies = spark.createDataFrame([(1, "2, 0, 2, 9"), (2, "NONE")], "query_id int, reply string")
    order = lambda df: [(r.query_id, r.id) for r in df.orderBy("query_id", "place").collect()]
    assert order(retrieval.reranked(rows, replies, 4, 2)) == [(1, "d2"), (1, "d0"), (2, "d0"), (2, "d1"), (3, "d0"), (3, "d1")]
    assert order(retrieval.reranked(rows, replies, 4, 2, none_is_empty=True)) == [(1, "d2"), (1, "d0")]
    assert order(retrieval.reranked(rows, replies, 2, 2)) == [(q, d) for q in (1, 2, 3) for d in ("d0", "d1")]


def test_breadcrumbs_keep_whole_texts(spark, tmp_path):
    from millrace.plans.rerank_queries import chk1e_breadcrumbs

    texts = ["a" * 349 + "\n" + "b" * 349, "a" * 349 + "\n" + "b" * 348, "", "\n\n", "x" * 2000 + "\ny", "\n".join("line %d " % i * 5 for i in range(90)), None]
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted, parent = [], None
    for i, text, lang, source in rows[:-1]:
        buffer, size, pieces = [], 0, []
        for line in text.split("\n"):
            if buffer and size + len(line) + 1 > 700:
                pieces.append("\n".join(buffer))
                buffer, size = [], 0
            buffer.append(line)
            size += len(line) + 1
        pieces.append("\n".join(buffer))
        wanted += [(i, n, f"[{parent + ' > ' if parent else ''}{source}] {x}") for n, x in enumerate(pieces)]
        parent = lang
    assert sorted((r.doc_id, r.piece_no, r.piece) for r in chk1e_breadcrumbs(spark, str(tmp_path)).collect()) == wanted


def test_labels_of_whole_items(spark, tmp_path):
    from millrace.plans.document_queries import jn16_label_lines

    head = "the quick brown fox jumps over the lazy dog by the old river bank today."
    items = [(1, head + " Many ships sailed slowly past the harbour! was it\nfine weather on the northern coast? ok."), (2, None), (3, "")]
    docs = [(1, "many ships sailed slowly past the harbour\nnothing of that kind"), (1, "Fine weather on the northern coast"), (2, head + " and then some more"), (2, "harbour! was it"), (3, None), (4, "ships sailed slowly")]
    docs += docs[:1]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    wanted = set()
    for item, text in items:
        for no, label in enumerate(re.split(r"(?<=[.!?])\s+|\n", (text or "").lower())):
            for doc, body in docs:
                for at, line in enumerate((body or "").lower().split("\n")):
                    a, b = grams(label), grams(line)
                    if len(a & b) >= 4 and len(a & b) >= 0.8 * min(len(a), len(b)):
                        wanted.add((item, no, doc, at, round(len(a & b) / min(len(a), len(b)), 9)))
    assert {w[1] for w in wanted} >= {0, 1, 3}
    assert {(r.item_id, r.label_no, r.doc_id, r.line_no, r.score) for r in jn16_label_lines(spark, str(tmp_path)).collect()} == wanted


def test_first_places_ties_nulls_and_missing(spark):
    from millrace.operators.evaluation import first_places

    rows = spark.createDataFrame([("a", 5, 1, 0), ("a", 5, 2, 1), ("a", None, 3, 1), ("b", 1, 4, 0), (None, 9, 5, 0), (None, 3, 6, 1)], "k string, n int, id int, hit int")
    order = [F.col("n").isNull(), -F.col("n"), F.col("id")]
    found = first_places(rows, rows.drop("hit"), "k", order, {"hit": F.col("hit") == 1, "gap": F.col("n").isNull()})
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1, 2), ("b", None, None), (None, 1, None)], key=str)
    assert first_places(rows.limit(0), rows.limit(0), "k", order, {"hit": F.col("hit") == 1}).count() == 0


def test_sections_of_a_small_document(spark):
    from millrace.operators import sections

    rows = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "x" * 8), (1, 2, 2, "y" * 30 + "\n\n" + "z" * 30), (1, 3, 1, "B"), (1, 4, 2, "b")], "d int, seq int, level int, line string")
    assert sorted(map(tuple, sections.expanded(rows, "d", 2, 40).collect())) == [(1, 1, 0, "x" * 8), (1, 2, 0, "y" * 30), (1, 2, 1, "z" * 30), (1, 3, 0, "B\nb")]
    pieces = spark.createDataFrame([(1, 0, "s", "a", "long body"), (1, 1, "s", "b", "no"), (1, 2, "s", "", "me"), (1, 3, "t", "c", "no")], "d int, seq int, section string, subsection string, body string")
    merged = sections.short_pieces_merged(pieces, "d", 5).orderBy("seq").select("seq", "body").collect()
    assert [tuple(r) for r in merged] == [(0, "long body\n[b] no\nme"), (3, "no")]
    lines = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(["Group", "before " * 6, "Hidden", "1", "step " * 8, "Group", "after " * 7, "제품 규격", "w " * 20])], "d int, page int, seq int, line string")
    titles = spark.createDataFrame([(1, 0, 0, 2, "Group")], "d int, page int, seq int, level int, title string")
    found = sections.segmented_by_titles(lines, titles, "d").orderBy("seq").collect()
    assert [(r.seq, r.heading) for r in found] == [(0, "Group"), (2, "Group > Hidden"), (5, "Group > Group"), (7, "Group > 제품 규격")]


def test_chapters_are_found_beyond_the_printed_table(spark):
    from millrace.operators import sections

    names = [f"Title {i} (x)" for i in range(5)]
    titles = spark.createDataFrame([(1, i, t, 0 if i else 3) for i, t in enumerate(names)] + [(1, 9, "nowhere", 1)], "d int, seq int, title string, hint int")
    lines = spark.createDataFrame([(1, 0, t) for t in names] + [(1, 2 + i, f" Title {i} ") for i in range(5)] + [(1, 4, "Title 0"), (1, 8, "end")], "d int, page int, line string")
    found = sections.recovered_chapters(titles, lines, "d").orderBy("seq").collect()
    assert [(r.seq, r.page, r.page_end) for r in found] == [(0, 4, 5), (1, 3, 4), (2, 4, 5), (3, 5, 6), (4, 6, 9)]


#: 0-based ranks of the wanted chunk for 104 labelled questions, and what they come to.
RANKS = [
    4, 88, 4, 9, 3, 1, 75, 6, 1, 2, 4, 0, 2, 60, 0, 36, 21, 7, 12, 4, 1, 0, 6, 13, 0, 10, 28, 0, 22, 2, 10, 6, 8, 6, 43, 1, 2, 3, 51, 5, 9, 0, 0, 0, 1, 0, 0, 1, 0, 42, 0, 3,
    0, 0, 1, 3, 0, 14, 1, 1, 9, 0, 0, 0, 57, 1, 4, 36, 6, 0, 0, 40, 5, 27, 8, 2, 0, 3, 0, 52, 1, 8, 6, 0, 17, 23, 0, 2, 1, 0, 1, 1, 11, 9, 3, 0, 1, 0, 0, 0, 35, 0, 41, 16,
]
SUMMARY = (104, 0.4338105481536766, 0.28846153846153844)
RECALL = {
    1: 0.28846153846153844, 3: 0.49038461538461536, 5: 0.5961538461538461, 10: 0.75, 20: 0.8269230769230769, 35: 0.875, 40: 0.9038461538461539, 60: 0.9711538461538461,
    80: 0.9903846153846154, 100: 1.0, 128: 1.0,
}


def test_published_ranks_give_published_figures(spark):
    ranks = spark.createDataFrame([(r,) for r in RANKS], "target_rank int")
    assert tuple(evaluation.rank_summary(ranks).head()) == pytest.approx(SUMMARY, abs=1e-12)
    assert {r.k: r.recall for r in evaluation.recall_at(ranks).collect()} == pytest.approx(RECALL, abs=1e-12)
