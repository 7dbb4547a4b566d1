"""Every registered query of the reference's operators against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import applied_queries, catalog_queries, document_queries, evaluation_queries, layout_queries, report_queries, symptom_queries, rerank_queries, retrieval_queries, routing_queries, scalar_queries, segment_queries, service_queries, structure_queries, turn_queries  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        relation = duck.sql(ORACLES[name])
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        assert found == sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in relation.fetchall())
    else:
        assert found
