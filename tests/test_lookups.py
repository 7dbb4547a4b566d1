"""Code lookups and features: lists in blocks against brute force, and plans that don't shuffle what meets."""

import re

import pytest

from millrace.plans import service_queries, turn_queries  # noqa: F401  (they register their queries)
from millrace.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lookups"))
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    parts = [(i // 2 if i % 40 == 3 else i, ["red bolt", "rad bolt", "old ring"][i % 3], f"Brand#{i % 2}", types[i % 6], i % 50) for i in range(900)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{at}/part.parquet")
    events = [(i if i % 30 else 7, i % 3, ["view", "error"][i % 2], float(i % 5)) for i in range(400)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    vectors = [(i, [float(i % 7), float(i % 11)], i % 4) for i in range(0, 400, 5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["jn1_code_lookup", "rte8_rendered_entries", "rte1_service_turns", "jn4_features"])
def test_against_sql(spark, folder, monkeypatch, name):
    import duckdb

    monkeypatch.setattr(service_queries, "ENTRY_BLOCK", 3)
    duck = duckdb.connect()
    for t in ("part", "events", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet/*.parquet'")
    wanted = duck.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    # rows of one key are pooled, whatever other columns say
    assert sorted(map(str, map(tuple, QUERIES[name](spark, folder).select(columns).collect()))) == sorted(map(str, wanted.fetchall()))


def test_pairs_are_not_shuffled(spark, folder):
    for name in ("jn1_code_lookup", "rte8_rendered_entries"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in re.split(r"Generate inline", plan)[0]


def test_features_meet_distinct_models(spark, folder):
    joined = service_queries._features(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    above = joined.split(" LIKE ")[1]
    assert above.count("Aggregate [brand") >= 2  # both sides of the pattern match are distinct
