"""Details in which results once differed from SQL: digits and wide blanks at ends of paragraphs, ends of words."""

from millrace.operators import chunking, sections


def test_paragraphs_keep_digits_at_their_ends(spark):
    texts = ["0 call 10\n\n1 or 21\n\n　 2 wide ", " \n\n \n\nx 20"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.piece) for r in chunking.packed_paragraphs(rows).collect()}
    assert found == {(0, "0 call 10\n\n1 or 21\n\n2 wide"), (1, "x 20")}
    lines = spark.createDataFrame([(1, 0, 1, "0 " + "x" * 40 + " 10")], "d int, seq int, level int, line string")
    assert [r.piece for r in sections.expanded(lines, "d", 2, 40).collect()] == ["0 " + "x" * 40 + " 10"]


def test_words_end_at_letters_with_marks(spark, tmp_path):
    from millrace.plans.report_queries import evl14_real_queries

    texts = ["éthe x", "theé", "bathe", "the_", "THE", "leſ", "x les.", None]
    spark.createDataFrame([(0, n, "assistant", t) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert evl14_real_queries(spark, str(tmp_path)).head().code_hits == 5


def test_labels_are_cut_at_their_ends_as_in_sql(spark):
    import duckdb

    from millrace.plans import layout_queries as L

    said = ["feed the hopper slowly", "Rear ereson attioner, ntea", "- we feed the hopper in due", "e\tfuel tank and cap •", "ufe ufe ufe ufe ufe"]
    labels = spark.createDataFrame([(1, n, t) for n, t in enumerate(said)], "doc_id long, nth int, label string")
    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(said)], "doc_id long, line int, text string")
    found = {(r.nth, r.line): r.sim for r in L._cosines(labels, lines, ["nth"]).collect()}
    sql = f"""WITH t AS (SELECT n, clean, {L._gram("lower(clean)", 3)} AS g FROM (SELECT n, {L._clean("x")} AS clean FROM (SELECT unnest(?) AS x, unnest(range(5)) AS n)))
        SELECT a.n, b.n, len(list_intersect(a.g, b.g)) / sqrt(len(a.g) * len(b.g)) AS sim FROM t a, t b WHERE length(a.clean) >= 12 AND length(b.clean) >= 12 AND sim >= 0.45"""
    assert found == {(a, b): sim for a, b, sim in duckdb.execute(sql, [said]).fetchall()}
