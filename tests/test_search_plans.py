"""Plans of queries on vector search: what is shuffled, and how often the search runs."""

import duckdb
import pytest

from millrace.plans import report_queries, rerank_queries, retrieval_queries, service_queries, structure_queries  # noqa: F401  (they register their queries)
from millrace.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("searches"))
    vectors = [(i, [float(i % 7), float(i % 11)], i % 4) for i in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    texts = [(i, None if i % 9 == 5 else "é" * 100 + "x" * 5000) for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_source_rows_shuffle_snippets(spark, folder):
    rows = QUERIES["rte9_source_rows"](spark, folder)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in plan[plan.index("Join"):].split("documents")[0]
    found = rows.collect()
    assert len(found) > 40 and {r.snippet for r in found} == {"é" * 100 + "x" * 120}


@pytest.mark.parametrize("name", ["agg10_least_distances", "evl15_same_chapter_misses", "vec4_pointwise", "vec7_structural_first"])
def test_search_runs_once(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet/*.parquet'")
    rows = QUERIES[name](spark, folder)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") <= 1
    wanted = duck.sql(ORACLES[name])
    at = [wanted.columns.index(c) for c in rows.columns]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(plain, r)) for r in rows.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())
