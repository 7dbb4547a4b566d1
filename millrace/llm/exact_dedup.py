"""Exact dedup by content-defined chunk recipes.

A text is cut where a hash of the last bytes says so, each distinct chunk is stored once under an identifier whose
bytes are verified, and documents are compared by their ordered identifier lists, which are short.

Nulls count as empty texts; all empty texts are equal to each other (an empty recipe). Rows that repeat a doc_id and
text count as rows of one group; where several rows of a group have its largest doc_id, or all of them none,
``exact_groups`` marks these all as kept, since ids don't tell them apart; ``without_exact_copies`` keeps one row of each
group in any case. A text of any length is chunked in a block of its own. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, numbered, one_row_of_each, text_bytes, worker_state, written
from millrace.llm.rolling import window_hashes

#: Bytes that decide a cut, mean distance of cuts as a power of two, and the limits of a chunk.
WINDOW, MEAN_BITS, LEAST, MOST = 32, 11, 256, 16384

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text; they depend on the text alone, not on its neighbours in the block."""
    marks = np.nonzero(window_hashes(data, WINDOW) >> np.uint64(64 - MEAN_BITS) == 0)[0] + WINDOW
    first = np.searchsorted(marks, offsets[:-1] + max(LEAST, WINDOW))
    last = np.searchsorted(marks, offsets[1:])
    found = []
    for start, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist()):
        cuts = []
        for mark in marks[a:b].tolist():
            while mark - start > MOST:
                start += MOST
                cuts.append(start)
            if mark - start >= LEAST and mark < end:
                cuts.append(mark)
                start = mark
        while end - start > MOST:
            start += MOST
            cuts.append(start)
        if end > start:
            cuts.append(end)
        found.append(cuts)
    return found


def _normalised(column: pa.Array) -> tuple[bytes, np.ndarray]:
    data, offsets = text_bytes(column)
    return _LOWER[data], offsets


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("exact_dedup")
    for block in blocks(batches):
        data, offsets = _normalised(block.column("text"))
        raw, starts = data.tobytes(), offsets.tolist()
        digests, whole = [], []
        for start, end, cuts in zip(starts, starts[1:], cut_points(data, offsets)):
            edges = [start, *cuts]
            digests.append([hashlib.sha256(raw[a:b]).digest() for a, b in zip(edges, edges[1:])])
            whole.append(hashlib.sha256(raw[start:end]).hexdigest())
        yield pa.record_batch(
            [block.column("doc_id"), pa.array(whole, pa.string()), pa.array(digests, pa.list_(pa.binary()))],
            ["doc_id", "text_sha256", "digests"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("exact_dedup")
    for block in blocks(batches):
        data, offsets = _normalised(block.column("text"))
        raw, seen = data.tobytes(), {}
        for start, cuts in zip(offsets.tolist(), cut_points(data, offsets)):
            edges = [start, *cuts]
            for a, b in zip(edges, edges[1:]):
                seen[raw[a:b]] = None
        yield pa.record_batch(
            [pa.array([hashlib.sha256(x).digest() for x in seen], pa.binary()), pa.array(list(seen), pa.binary())], ["digest", "chunk"]
        )


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, digests): each text's chunks in order, by digest."""
    return docs.select("doc_id", "text").mapInArrow(_recipes, "doc_id long, text_sha256 string, digests array<binary>")


def chunk_store(docs: DataFrame) -> DataFrame:
    """(chunk_id, chunk): every distinct chunk once, its bytes verified against all that carry its digest.

    The least and the greatest chunk of a digest are equal exactly if all are; copies meet before the shuffle.
    Two chunks with one digest end the job: identifiers that lie would be worse.
    """
    chunks = docs.select("text").mapInArrow(_chunks, "digest binary, chunk binary")
    ends = chunks.groupBy("digest").agg(F.min("chunk").alias("chunk"), F.max("chunk").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two chunks with digest "), F.hex("digest")))
    return ends.select(F.when(F.col("chunk") == F.col("other"), F.col("digest")).otherwise(clash.cast("binary")).alias("chunk_id"), "chunk")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``; of equal texts the largest doc_id stays.

    Only digests and identifiers are shuffled besides one copy of each distinct chunk. A recipe that a third of the
    rows share is counted before the shuffle; the join back has one row per recipe on its other side, so adaptive
    execution can split the hot partition.
    """
    listed = written(recipes(docs).withColumn("row", F.monotonically_increasing_id()), "recipes")
    verified = written(chunk_store(docs).select("chunk_id"), "chunk-ids")
    parts = listed.select("row", F.posexplode("digests").alias("nth", "digest"))
    lists = (
        parts.join(verified, F.col("digest") == F.col("chunk_id"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))).alias("chunks"))
        .select("row", F.col("chunks.chunk_id").alias("ids"))
    )
    rows = written(
        listed.drop("digests").join(lists, "row", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<binary>"))).select("doc_id", "text_sha256", "ids"),
        "recipe-ids",
    )
    groups = rows.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "recipe-groups")  # so that the join below has its own exchanges, which can be split
    return rows.join(groups, "ids").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group; all columns stay. The largest doc_id stays, a null only where
    all are null, and of rows that repeat it the first."""
    rows = numbered(docs, "exact-rows")
    found = exact_groups(rows.select(F.col("row_no").alias("doc_id"), "text")).where("group_size > 1")
    keeper = F.max_by("row_no", F.struct("doc_id", -F.col("row_no")))  # nulls are least
    groups = found.select(F.col("doc_id").alias("row_no"), F.col("keep_id").alias("group"))
    return one_row_of_each(rows, groups, keeper, "exact").select(*docs.columns)
