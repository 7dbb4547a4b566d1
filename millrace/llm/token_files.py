"""Token-id output: length-delimited binary records in shard files, with a separate offset index.

Shard file: records one after another, each ``u64 n | u32 masked(n) | n bytes | u32 masked(bytes)``, little-endian.
The n bytes are a document's ids, 2 bytes each while the vocabulary has at most 65,536 ids, else 4. A checksum is
crc32, rotated right by 15 bits plus a constant, so that checksums of data that hold checksums stay sound.
Index file: per record ``i64 doc_id | u64 offset | u64 n_tokens``, so that a reader can fetch records in any order.

Shards are in ascending doc_id order (range partitions, sorted within). Each attempt of a task writes under a name of
its own; the manifest that the job returns names the files of the attempts that counted, so lost executors and
repeated tasks leave at most unreferenced files.

Null and empty texts give a record of the end id alone; a null doc_id sorts first and is stored as the least long.
Rows that repeat a doc_id are ordered by text. An empty table has no shards. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import blocks, shared_folder, worker_state, written
from millrace.llm.pretokens import pieces

MASK = 0xA282EAD8
NO_ID = -(1 << 63)
#: Pieces whose ids a Python worker keeps between batches and tasks.
KEPT_PIECES = 500_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframed(record: memoryview) -> bytes:
    """The payload of one record; ValueError if a checksum or the length is wrong."""
    size = bytes(record[:8])
    if struct.unpack("<I", record[8:12])[0] != masked(size) or len(record) != struct.unpack("<Q", size)[0] + 16:
        raise ValueError("a record's length is damaged")
    payload = bytes(record[12:-4])
    if struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("a record's bytes are damaged")
    return payload


def _tokenizer(path: str):
    state = worker_state("token_files")
    if path not in state:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        state[path] = (Tokenizer.from_file(path), {})
    return state[path]


def piece_ids(words: list[str], path: str) -> list[np.ndarray]:
    """Ids of each distinct piece by the tokenizers library. The library merges within pieces only, and splits by the
    same pattern, so encoding each distinct piece once gives what encoding whole texts gives."""
    tokenizer, known = _tokenizer(path)
    found = [known.get(w) for w in words]
    new = [i for i, ids in enumerate(found) if ids is None]
    for first in range(0, len(new), 20_000):
        some = new[first : first + 20_000]
        for i, encoding in zip(some, tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
            found[i] = np.array(encoding.ids, np.uint32)
            if len(known) < KEPT_PIECES and len(words[i]) < 40:
                known[words[i]] = found[i]
    return found


def ragged(codes: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of values[c] for c in codes, and the length of each."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate([*values, np.zeros(0, np.uint32)])
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - own), own)
    return flat[at], own


def encoded(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, each with the end id, and the edges between texts.

    The library looks for added tokens before it splits, so texts that hold one are encoded whole.
    """
    tokenizer = _tokenizer(path)[0]
    special = np.zeros(len(column), bool)
    for token in tokenizer.get_added_tokens_decoder().values():
        special |= pc.fill_null(pc.match_substring(column, token.content), False).to_numpy(zero_copy_only=False)
    whole_texts = column.filter(pa.array(special)).to_pylist()
    if whole_texts:
        column = pc.if_else(pa.array(special), pa.scalar("", column.type), column)
    words, counts = pieces(column)
    ids, sizes = ragged(words.indices.to_numpy(), piece_ids(words.dictionary.to_pylist(), path))
    edges = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
    if whole_texts:
        found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(whole_texts, add_special_tokens=False)]
        lengths = np.zeros(len(column), np.int64)
        lengths[special] = [len(x) for x in found]
        ids = np.insert(ids, np.repeat(edges[:-1], lengths), np.concatenate(found))
        edges = edges + np.append(0, np.cumsum(lengths))
    whole = np.insert(ids, edges[1:], end_id)
    return whole, edges + np.arange(len(edges))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns the manifest: (shard, path, index_path, width, n_docs, n_tokens)."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = 2 if _tokenizer(tokenizer)[0].get_vocab_size() <= 1 << 16 else 4
        store = data = None
        index: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = total = 0
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        for block in blocks(batches):
            if data is None:
                store, root = pyarrow.fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                data = store.open_output_stream(f"{root}/{name}.rec")
            ids, edges = encoded(block.column("text"), tokenizer, end_id)
            raw = memoryview(ids.astype(f"<u{width}").tobytes())
            records = [framed(bytes(raw[a * width : b * width])) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            sizes = np.fromiter(map(len, records), np.int64, len(records))
            data.write(b"".join(records))
            keys = block.column("doc_id").fill_null(NO_ID).to_numpy()
            index.append((keys, at + np.cumsum(sizes) - sizes, np.diff(edges)))
            at += int(sizes.sum())
            total += len(ids)
        if data is None:
            return
        data.close()
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            rows = np.stack([np.concatenate(x).astype("<i8") for x in zip(*index)], axis=1)
            out.write(rows.tobytes())
        yield pa.record_batch(
            [pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}.rec"]), pa.array([f"{folder}/{name}.idx"]), pa.array([width], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([total], pa.int64())],
            ["shard", "path", "index_path", "width", "n_docs", "n_tokens"],
        )

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.mapInArrow(write, "shard int, path string, index_path string, width int, n_docs long, n_tokens long"), "token-manifest")


def _file(path: str):
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def read_index(path: str) -> np.ndarray:
    """Rows (doc_id, offset, n_tokens) of an index file."""
    with _file(path) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def read_records(path: str, width: int, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of the given rows of an index, in the order given; each record is verified."""
    with _file(path) as f:
        for _, offset, n in rows.tolist():
            yield np.frombuffer(unframed(memoryview(f.read_at(n * width + 16, offset))), f"<u{width}").astype("<u4")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files that the manifest names.

    ``start`` counts the ids of all documents before it: sums over shards (one row each) and within a shard's index.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("first", F.coalesce(before, F.lit(0)).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(row["index_path"])
                for a in range(0, len(index), 4096):
                    some = index[a : a + 4096]
                    crcs = [zlib.crc32(ids.tobytes()) for ids in read_records(row["path"], row["width"], some)]
                    starts = row["first"] + np.cumsum(index[:, 2])[a : a + 4096] - some[:, 2]
                    yield pa.record_batch(
                        [pa.array(some[:, 0], mask=some[:, 0] == NO_ID), pa.array(starts), pa.array(some[:, 2]), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # a task per shard: without a number, adaptive execution would put these few rows into one task
    spread = placed.repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
