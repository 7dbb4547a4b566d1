"""Routing, answers, collections and files on small relations."""

import json

from pyspark.sql import functions as F

from millrace.operators import answers, retrieval, routing, toc
from millrace.sources import files


def test_routes(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    codes = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2)], "query_id int, id string, rank int")
    absent = spark.createDataFrame([(1, "f"), (2, "f")], "query_id int, id string")
    vector = spark.createDataFrame([(1, "v", 0.2, 1), (3, "v", 0.2, 1), (3, "w", 0.95, 2)], "query_id int, id string, distance double, rank int")
    search = lambda rest: vector.join(rest, "query_id", "left_semi")
    found = {(r.query_id, r.route, r.id, r.used) for r in routing.routed(questions, codes, absent, search).collect()}
    assert found == {(1, "error_code", "c1", True), (1, "error_code", "c2", True), (2, "feature_absent", "f", True), (3, "vector", "v", True), (3, "vector", "w", False), (4, "none", None, False)}
    filled = routing.routed(questions, codes, absent, search, fill=3).where("query_id = 1").orderBy("place").collect()
    assert [r.id for r in filled] == ["c1", "c2", "v"]


def test_gate(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, 1.0, True), (3, 1.0, None), (4, 2.0, True)], "query_id int, distance double, ok boolean")
    assert {r.query_id: r.answered for r in routing.gated(rows, F.col("ok")).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_warnings_and_flush(spark):
    rows = spark.createDataFrame([("Unplug it first. Then clean.", False), ("Short", False), ("Clean it.", True), ("x" * 100, False)], "t string, due boolean")
    out = [r[0] for r in rows.select(answers.with_warning(F.col("t"), F.col("due"), "(?i)unplug", "WARNING")).collect()]
    assert out == ["Then clean.", "Short", "WARNING\nClean it.", "x" * 100]
    assert rows.where("t LIKE 'x%'").select(F.length(answers.first_sentence(F.col("t")))).head()[0] == 80


def test_event_order_and_judging(spark):
    events = spark.createDataFrame([(1, 0, "conv"), (1, 1, "token"), (1, 2, "status"), (2, 0, "conv")], "message_id int, seq int, type string")
    assert [(r.message_id, r.seq) for r in answers.out_of_order(events, ("conv", "status", "sources", "token", "figures", "done")).collect()] == [(1, 2)]
    rows = spark.createDataFrame([("FALSE_DECLINE", "‘the  Filter’", "clean the filter now"), ("FALSE_DECLINE", "none", "x"), ("SUCCESS", "", "x")], "label string, quote string, ev string")
    assert [r.label for r in answers.judged(rows, "ev").collect()] == ["FALSE_DECLINE", "GENUINE_NO_ANSWER", "SUCCESS"]


def test_fallback(spark):
    rows = spark.createDataFrame([("b", 2, "m", [0.0, 1.0]), ("a", 1, "m", [1.0, 0.0]), ("c", 3, "n", [1.0, 1.0])], "id string, seq int, scope string, vector array<double>")
    assert rows.where(retrieval.metadata_filter({"scope": "m"})).count() == 2
    questions = spark.createDataFrame([(1, "m", [1.0, 0.1]), (2, "zz", [1.0, 0.1])], "query_id int, scope string, query_vector array<double>")
    near = retrieval.nearest(questions, rows, "scope", 1)
    both = retrieval.with_fallback(near, questions, lambda q: retrieval.nearest(q.withColumn("scope", F.lit("n")), rows, "scope", 1))
    assert {r.query_id: r.id for r in both.collect()} == {1: "a", 2: "c"}


def test_toc_parents_and_titles(spark):
    rows = [(1, 0, 1, "A", 1), (1, 1, 2, "x", 1), (1, 2, 3, "y", 2), (1, 3, 2, "z", 5), (1, 4, 1, "B", 9), (1, 5, 2, "x", 30)]
    df = spark.createDataFrame(rows, "doc int, seq int, level int, title string, page int")
    assert [r.parent_seq for r in toc.with_parents(df, "doc", 3).orderBy("seq").collect()] == [None, 0, 1, 0, None, 4]
    assert [r.heading for r in toc.unique_titles(df, "doc", 3).orderBy("seq").collect()] == ["A", "[A] x", "y", "z", "B", "[B] x"]
    assert [r.seq for r in toc.boundaries(df, "doc", 3, F.col("title") == "A").orderBy("seq").collect()] == [2, 3, 5]
    spans = toc.spans(df.where("level = 1"), "doc", "seq", 20).orderBy("seq").collect()
    assert [(r.page, r.page_end) for r in spans] == [(1, 9), (9, 10)]


def test_files(spark, tmp_path):
    product = {"product_model": "M", "product_name": "N", "sections": [{"type": "error", "title": "CH05 (fan)", "content": "c"}, {"type": "e", "title": "t", "content": None}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "acme_air_con_errors.json").write_text(json.dumps([product]))
    found = files.section_files(spark, str(tmp_path / "in")).orderBy("section_no").collect()
    assert [(r.brand, r.category, r.section_no, r.title) for r in found] == [("acme", "air_con", 0, "CH05 (fan)"), ("acme", "air_con", 1, "t")]
    (tmp_path / "pdf" / "acme" / "air").mkdir(parents=True)
    (tmp_path / "pdf" / "acme" / "air" / "acme_X_1.pdf").write_bytes(b"%PDF")
    row = files.manual_files(spark, str(tmp_path / "pdf")).head()
    assert (row.brand, row.category, row.model, row.length) == ("acme", "air", "X_1", 4)
    files.write_report(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "name string, value double"), str(tmp_path / "out"), "Run")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.index("| a | 1.0 |") < text.index("| b | 2.0 |")


def test_reports_and_documents_round_trip(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps([{"id": "1", "text": "x\ny", "metadata": {"k": "v", "n": 2}}, {"id": "2", "text": None}]))
    assert [(r.id, r.text, r.metadata) for r in files.document_files(spark, str(tmp_path / "docs")).orderBy("id").collect()] == [("1", "x\ny", {"k": "v", "n": "2"}), ("2", None, None)]
    for name, rank in (("run1.json", 1), ("run2.json", None)):
        (tmp_path / "results").mkdir(exist_ok=True)
        (tmp_path / "results" / name).write_text(json.dumps({"rows": [{"rank": rank}]}))
    found = files.result_files(spark, str(tmp_path / "results"), "rows array<struct<rank:int>>").orderBy("file_name").collect()
    assert [(r.file_name, r.rows[0].rank) for r in found] == [("run1.json", 1), ("run2.json", None)]
    rows = spark.createDataFrame([(1, 'say "hi", twice\nthen'), (2, None)], "no int, reason string")
    files.write_json_report(rows, str(tmp_path / "json"))
    assert sorted(json.loads(r.value)["no"] for r in spark.read.text(str(tmp_path / "json")).collect()) == [1, 2] and all("reason" in r.value for r in spark.read.text(str(tmp_path / "json")).collect())
    files.write_audit(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"), schema="no int, reason string")
    assert {(r.no, r.reason) for r in back.collect()} == {(1, 'say "hi", twice\nthen'), (2, None)}
    files.write_report(rows.selectExpr("concat('m', no) AS name", "no AS value").repartition(3), str(tmp_path / "md"), "T")
    lines = [line for p in sorted((tmp_path / "md").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["# T", "", "| name | value |", "|-|-|", "| m1 | 1 |", "| m2 | 2 |"]


def test_citations_of_long_conversations(spark, tmp_path):
    from millrace.plans.routing_queries import fn33_citations

    turns = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in [*range(25), 7, 130]] + [(2, 0, "assistant", "x"), (2, 12, "assistant", None), (None, 1, "assistant", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    wanted = set()
    for c, t, role, text in turns:
        pages = sorted({b for a, b, *_ in turns if a == c and c is not None and b < t})
        if role == "assistant" and pages:
            wanted.add((c, t, text, f"(p. {', '.join(map(str, pages))})"))
    found = [tuple(r) for r in fn33_citations(spark, str(tmp_path)).collect()]
    assert set(found) == wanted and len(found) == len(wanted)
