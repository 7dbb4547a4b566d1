"""Vector search by pairs of blocks against brute force."""

import math
import random

import pyarrow as pa
import pytest

from millrace.operators import retrieval


def brute(queries, chunks, most):
    out = set()
    for q, scope, a in queries:
        rows = []
        for i, other, b in chunks:
            if scope is None or other != scope:
                continue
            parts = [(x - y) * (x - y) for x, y in zip(a or [], b or []) if x is not None and y is not None]
            apart = sum(parts) if parts else None
            rows.append((apart is None, math.isnan(apart or 0), apart or 0, i, apart))
        rows.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2], r[3]))
        out |= {(q, r[3], None if r[4] is None else f"{r[4]:.9g}", n + 1) for n, r in enumerate(rows[:most])}
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_blocks_against_brute_force(spark, monkeypatch, odd):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 11)
    rng = random.Random(5)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]  # noqa: E731  (many ties)
    chunks = [(i, rng.choice(["a", "b", None]), vector()) for i in range(120)]
    queries = [(i, rng.choice(["a", "b", "c", None]), vector()) for i in range(40)]
    if odd:
        chunks += [(200, "a", None), (201, "a", [None, 1.0, 1.0]), (202, "b", [float("nan"), 0.0, 0.0]), (203, "b", [float("inf"), 0.0, 0.0]), (204, "a", [1.0]), (205, "a", [])]
        queries += [(300, "a", None), (301, "b", [float("inf"), 0.0, None])]
    found = retrieval.nearest(
        spark.createDataFrame(queries, "query_id long, scope string, query_vector array<float>"), spark.createDataFrame(chunks, "id long, scope string, vector array<float>"), "scope", 5 if not odd else 60
    )
    assert {(r.query_id, r.id, None if r.distance is None else f"{r.distance:.9g}", r["rank"]) for r in found.collect()} == brute(queries, chunks, 5 if not odd else 60)


def test_chunks_are_sent_once_for_thousands_of_queries(spark, monkeypatch):
    def counting(most):
        def search(asked, held):
            return pa.table({"query_id": asked["query_id"].slice(0, 1), "id": held["id"].slice(0, 1), "distance": [float(len(held))]})

        return search

    monkeypatch.setattr(retrieval, "_block_search", counting)
    queries = spark.range(6000).selectExpr("id AS query_id", "id % 2 AS scope", "array(1.0f) AS query_vector")
    chunks = spark.range(500).selectExpr("id", "id % 2 AS scope", "array(2.0f) AS vector")
    assert sum(r.distance for r in retrieval.nearest(queries, chunks, "scope", 1000).collect()) == 500


@pytest.mark.parametrize("most", [1, 3, 40, 150, 1000])
def test_bound_by_groups_of_chunks(most):
    rng = random.Random(most)
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]  # noqa: E731  (many ties)
    chunks, queries = [(i, "a", vector()) for i in range(1003)], [(i, "a", vector()) for i in range(30)]
    table = lambda rows, names: pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], names=names)
    found = retrieval._block_search(most)(table(queries, ["query_id", "query_vector"]), table(chunks, ["id", "vector"])).to_pylist()
    wanted = brute(queries, chunks, most)
    assert {(r["query_id"], r["id"], f"{r['distance']:.9g}") for r in found} == {w[:3] for w in wanted} and len(found) == len(wanted)
