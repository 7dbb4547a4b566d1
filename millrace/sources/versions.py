"""Changes applied to a stored keyed table, so that a repeated run changes nothing and a reader never sees half of one.

A table is a folder of versions. Each holds the rows of the hash buckets that a change touched, whole, and a commit file
that names them, written last; without it a version doesn't exist for readers. A reader takes each bucket from the last
version that touched it, and nothing from before the last full one. Versions are numbered, and carry the name of the
batch that made them: a batch that is committed already is not applied again. One writer at a time is assumed, as with
any table without locks; files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: what is listed on the driver is one line a bucket and version.
BUCKETS = 64
COMMIT, BUCKET = "commit.json", "__bucket"


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[dict]:
    """Committed versions in order: number, batch, folder, full, buckets, schema."""
    path, system = _files(spark, root)
    found = []
    for status in system.listStatus(path) if system.exists(path) else []:
        name = status.getPath().getName()
        commit = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), COMMIT)
        if re.fullmatch(r"v\d{8}-.*", name) and system.exists(commit):
            stream = system.open(commit)
            try:
                said = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            finally:
                stream.close()
            found.append(said | {"folder": f"{root.rstrip('/')}/{name}"})
    return sorted(found, key=lambda v: v["number"])


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def current(spark: SparkSession, root: str, only: set[int] | None = None) -> DataFrame | None:
    """The table's rows, of all buckets or some; None if it has no version."""
    known = versions(spark, root)
    if not known:
        return None
    last = max((i for i, v in enumerate(known) if v["full"]), default=0)
    owner: dict[int, str] = {}
    for v in known[last:]:
        owner.update({b: v["folder"] for b in v["buckets"]})
    wanted = sorted({f"{folder}/{BUCKET}={b}" for b, folder in owner.items() if only is None or b in only})
    _, system = _files(spark, root)
    paths = [p for p in wanted if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    schema = known[-1]["schema"]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def applied(root: str, rows: DataFrame, key: list[str], batch: str, touched: set[int] | None = None, buckets: int = BUCKETS) -> bool:
    """Writes ``rows`` as the whole contents of the touched buckets (all of them, if None); False if done before."""
    spark = rows.sparkSession
    known = versions(spark, root)
    if any(v["batch"] == batch for v in known):
        return False
    number = known[-1]["number"] + 1 if known else 1
    name = re.sub(r"[^A-Za-z0-9_.-]", "_", batch)
    folder = f"{root.rstrip('/')}/v{number:08d}-{name}"
    # overwrite: a version without its commit file is what an interrupted run left
    rows.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    said = {"number": number, "batch": batch, "full": touched is None, "buckets": sorted(range(buckets) if touched is None else touched), "schema": rows._jdf.schema().toDDL()}
    path, system = _files(spark, f"{folder}/{COMMIT}")
    out = system.create(path, False)
    try:
        out.write(bytearray(json.dumps(said).encode()))
    finally:
        out.close()
    return True


def _touched(keys: DataFrame, key: list[str], buckets: int) -> set[int]:
    return {r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect()}  # at most one row a bucket


def reload(root: str, rows: DataFrame, key: list[str], batch: str, buckets: int = BUCKETS) -> bool:
    """Truncates the table and loads ``rows``."""
    return applied(root, rows, key, batch, None, buckets)


def load_if_empty(root: str, rows: DataFrame, key: list[str], batch: str, buckets: int = BUCKETS) -> bool:
    """Loads ``rows`` if the table holds none; a table with rows is left alone."""
    held = current(rows.sparkSession, root)
    return (held is None or held.isEmpty()) and applied(root, rows, key, batch, None, buckets)


def upsert(root: str, rows: DataFrame, key: list[str], batch: str, buckets: int = BUCKETS) -> bool:
    """Rows of ``rows`` replace those of equal keys; only buckets that they fall into are read and written."""
    return _changed(root, rows.select(*key), rows, key, batch, buckets)


def delete(root: str, keys: DataFrame, key: list[str], batch: str, buckets: int = BUCKETS) -> bool:
    """Rows with one of ``keys`` go."""
    return _changed(root, keys.select(*key), None, key, batch, buckets)


def _changed(root: str, keys: DataFrame, rows: DataFrame | None, key: list[str], batch: str, buckets: int) -> bool:
    spark = keys.sparkSession
    if any(v["batch"] == batch for v in versions(spark, root)):
        return False
    touched = _touched(keys, key, buckets)
    held = current(spark, root, touched)
    if held is None:
        return rows is not None and applied(root, rows, key, batch, None, buckets)
    kept = held.join(keys, key, "left_anti")
    return applied(root, kept if rows is None else kept.unionByName(rows), key, batch, touched, buckets)


def next_id(spark: SparkSession, root: str, key: str) -> int:
    """The number after the greatest id, 1 for an empty table."""
    held = current(spark, root)
    most = None if held is None else held.agg(F.max(key)).head()[0]
    return 1 if most is None else most + 1
