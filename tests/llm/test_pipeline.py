"""The pipeline's stages against brute-force versions of each on its own input, and the queries' SQL."""

import base64
import hashlib
import os
from collections import Counter

import duckdb
import pytest
import tiktoken

import corpus_pipeline
from millrace.llm.queries import ORACLES, QUERIES

from .test_operators import components_by_force, lowered

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op8_toxicity"](spark, FOLDER).collect() if r.predicted}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]

    clean = stages["toxicity"](spark, docs, FOLDER).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic

    once = stages["exact_dedup"](spark, clean, FOLDER).cache()
    last = {}
    for r in clean.collect():
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
    assert {r.doc_id for r in once.collect()} == set(last.values())

    single = stages["jaccard_join"](spark, once, FOLDER).cache()
    found = components_by_force([(r.doc_id, r.text) for r in once.collect()])
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in found.items() if i == c}

    mixed = stages["mixing"](spark, single, FOLDER).cache()
    assert mixed.columns == docs.columns
    duck = duckdb.connect()
    duck.register("documents", single.toArrow())
    names = ["doc_id", "size", "taken"]
    plan = duck.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op7_mixing']})").fetchall()
    counts = Counter(r.doc_id for r in mixed.collect())
    assert all(counts[i] * size == taken for i, size, taken in plan) and max(counts.values()) <= 3

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text or "" for r in mixed.collect()}
    for r in stages["bpe"](spark, mixed, FOLDER).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    relation = duck.sql(ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
