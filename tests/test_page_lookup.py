"""Probes go to the pages: texts of pages are moved by one join, and every page that holds a probe is found."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import page_index


def test_texts_move_once(spark):
    text = "".join(f"word{i} and {i * i} more " for i in range(60))
    pages = spark.createDataFrame([(1, n, text[n * 200 : n * 200 + 260]) for n in range(5)] + [(2, 0, text)], "doc_id long, page long, text string")
    probes = spark.createDataFrame([(1, 0, 0, text[210:250]), (1, 0, 1, text[300:330]), (1, 1, 0, "nowhere to be found at all"), (1, 2, 0, text[400:410])], "doc_id long, piece_no int, i int, probe string")
    found = page_index.holding_pages(probes, pages, ["doc_id"], ["piece_no", "i"])
    wanted = {(1, p, i, page) for _, p, i, probe in map(tuple, probes.collect()) for doc, page, t in map(tuple, pages.collect()) if doc == 1 and probe in t}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) >= 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3


@pytest.mark.parametrize("direct", [1 << 17, 40])
def test_first_pages_as_by_force(spark, monkeypatch, direct):
    """Short and long documents: in text, and through anchors."""
    monkeypatch.setattr(page_index, "DIRECT", direct)
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.choice([0, 5, 90, 300])))
        pages = {n: text[i : i + 45] for n, i in zip(rng.sample(range(3, 30), 12), range(0, len(text), 30))}
        found = page_index.Pages(list(pages), list(pages.values()))
        for _ in range(40):
            i, low, high = rng.randrange(max(len(text), 1)), rng.choice([None, rng.randrange(32)]), rng.choice([None, rng.randrange(32)])
            probe = text[i : i + rng.choice([1, 17, 18, 19, 30])] or "a"
            wanted = [n for n, t in pages.items() if probe in t and (low is None or n >= low) and (high is None or n <= high)]
            assert found.first(probe, low, high) == min(wanted, default=None)


def test_texts_of_a_document_meet_in_one_row(spark):
    """One join by document, not by passages; documents without pages, null texts and null keys keep their pieces."""
    pages = spark.createDataFrame([(1, 2, "x" * 30 + " the knob turns slowly to the left"), (1, 1, "the knob turns slowly to the left"), (2, 0, None)], "doc_id long, page int, text string")
    pieces = spark.createDataFrame([(1, 0, "knob turns slowly to"), (1, 1, "not to be found"), (2, 0, "knob"), (3, 0, "knob"), (None, 0, "knob"), (1, 2, None), (1, 3, "x" * 25)], "doc_id long, piece_no int, piece string")
    found = page_index.assigned_pages(pieces, pages, ["doc_id"], "piece")
    assert {tuple(r) for r in found.collect()} == {(1, 0, 1, 1), (1, 1, None, None), (2, 0, None, None), (3, 0, None, None), (None, 0, None, None), (1, 2, None, None), (1, 3, 2, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "anchor" not in plan
    asked = pieces.select("doc_id", "piece_no", F.col("piece").alias("body"), F.lit(1).alias("claimed"))
    found = page_index.located_pages(asked, pages, ["doc_id"])
    assert found.count() == 7 and found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_sources_are_repaired_without_taking_messages_apart(spark):
    body = "press the small knob beside the door until it clicks twice and wait for the lamp"
    pages = spark.createDataFrame([(1, n, body if n == 4 else "nothing here") for n in range(1, 7)], "doc_id long, page int, text string")
    source = lambda doc, text, page: (doc, text, page, page)
    rows = [(1, [source(1, body, 2), source(None, body, 2), source(1, None, 3), source(1, body, None)]), (2, None), (3, []), (None, [source(1, body, 1)]), (4, [source(9, body, 5)])]
    held = spark.createDataFrame(rows, "m long, sources array<struct<doc_id:long,body:string,page_start:int,page_end:int>>")
    found = page_index.repaired_sources(held, pages, "m")
    got = {r.m: r.sources and [(s.page_start, s.page_end) for s in r.sources] for r in found.collect()}
    assert got == {1: [(4, 4), (2, 2), (3, 3), (None, None)], 2: None, 3: [], None: [(1, 1)], 4: [(5, 5)]}
    assert found.schema["sources"].dataType == held.schema["sources"].dataType
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
