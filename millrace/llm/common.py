"""Helpers that the operators share: the shared folder, written tables, and blocks of text as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one numpy pass handles; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20


_STATE: dict[str, dict] = {}


def worker_state(operator: str) -> dict:
    """What an operator keeps in this Python worker between blocks and tasks. A worker serves one operator after
    another, so another operator's state goes first."""
    if operator not in _STATE:
        _STATE.clear()
        release()
        _STATE[operator] = {}
    return _STATE[operator]


def release() -> None:
    """Gives freed memory back to the system: workers live on, and an executor's tasks share its memory."""
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """Gives back what is free already, without looking for more."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # only the GNU C library has it


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application: they may not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_millrace_sent", False):
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._millrace_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a plain local session (tests) gets a temporary folder and the setting; on a cluster a
    machine's own folder would lose rows, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with a number of its own for each row, ``row_no``, as a written table: doc_ids may repeat or be null."""
    return written(docs.withColumn("row_no", F.monotonically_increasing_id()), label)


def one_row_of_each(rows: DataFrame, groups: DataFrame, keeper: Column, label: str) -> DataFrame:
    """The rows of a numbered table that stay: of each group of ``groups`` (row_no, group) the one whose number
    ``keeper``, an aggregate over doc_id and row_no, names. Only numbers and doc_ids are joined by group."""
    groups = written(groups, f"{label}-groups")
    kept = groups.join(rows.select("row_no", "doc_id"), "row_no").groupBy("group").agg(keeper.alias("row_no"))
    dropped = written(groups.select("row_no").join(kept.select("row_no"), "row_no", "left_anti"), f"{label}-dropped")
    return rows.join(dropped, "row_no", "left_anti").drop("row_no")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string or binary array as one byte array with offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, starts, values = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if values is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most`` bytes of text at most."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last
    trim()  # a worker that waits for its next task keeps little
