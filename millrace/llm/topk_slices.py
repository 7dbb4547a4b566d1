"""Exact top-k search by a bit-sliced index: inner products of integer vectors.

Index. Components are integers, floor(1024 x). Rows of one length are dealt to blocks by a hash of their number. In a
block, each attribute is taken relative to its least value and quantised to its ``SLICES`` most significant bits; bit t
of attribute j over all rows of the block is one bitmap, a slice. A block also keeps its rows' whole integers.

Search. For a query q a block adds, for each attribute, the slices shifted by every bit of |q_j| (complemented where
q_j < 0), by full adders over whole bitmaps, column by column: the sum's slices are the scores of all rows at once.
From the most significant slice downward the k-th largest sum is selected. Quantising loses less than
sum |q_j| (2**r - 1), r being the bits dropped, so every row of the exact top k has a sum of at least that k-th one less
this bound: a comparison of slices with a constant gives these rows. They, the boundary rows among them, are resolved by
exact inner products of whole integers. A block yields its k best rows for a query; the best of all blocks are ranked
by score, then smaller id.

Plan. An index row meets the queries in blocks: chunks of ``CHUNK`` queries go to every block of their length, block and
chunks meet by sorting within a partition, and no pair of rows is ever a row of its own. A task holds one block and one
chunk. The best rows are cut to k for each query before and after their shuffle.

Every row is indexed and the result is exact, so recall is 1. Nulls: vectors that are null, or hold null or non-finite
components (also after scaling), take no part. Rows without id are candidates, last among ties, and never queries.
Rows that repeat an id are candidates and queries of their own: only the query's own row is left out. Equal vectors tie. Empty vectors score 0
with one another; vectors of another length than the query's aren't compared with it. Scores are ranked as integers of up
to 38 digits (longer ones tie with the largest of these) and those beyond long are returned as its limits. An empty table, or one without queries, gives an empty
result. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

SCALE, SLICES = 1024, 8
#: Rows of a block, queries of a chunk, chunks that meet a copy of a block in one task.
BLOCK, CHUNK, CHUNKS = 1 << 14, 64, 8
MOST_TASKS = 1 << 16
MOST_LONG = (1 << 63) - 1
#: Scores between blocks: decimals of 38 digits.
WIDE, MOST_WIDE = pa.decimal128(38, 0), 10**38 - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(row_no, vec_id, dim, v) of the vectors that take part; v holds floor(SCALE * x) as doubles."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    rows = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & whole).withColumn("dim", F.size("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists as integers: int64 where all fit with room for sums, else Python's own."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)
    if not values.size or np.abs(values).max() < 2.0**61:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def packed(values: np.ndarray) -> tuple[str, bytes]:
    """Integers as bytes of the least type that holds them, "" for those beyond 64 bits."""
    if values.dtype == object:
        return "", ",".join(map(str, values.ravel())).encode()
    top = max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
    kind = next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if top < most)
    return kind, values.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, dim: int, rows: int) -> np.ndarray:
    if not kind:
        return np.array([int(x) for x in data.decode().split(",")], object).reshape(rows, dim)
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, dim)


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """The last axis of booleans as 64-bit words, row i at bit i."""
    words = np.packbits(bits, axis=-1, bitorder="little")
    pad = -words.shape[-1] % 8
    return np.ascontiguousarray(np.pad(words, [(0, 0)] * (words.ndim - 1) + [(0, pad)])).view(np.uint64)


def positions(bitmap: np.ndarray, rows: int) -> np.ndarray:
    return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=rows))[0]


class Index:
    """The slices of one block: ``slices[sign, attribute, bit]`` are bitmaps, sign 1 holds complements."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        self.values, (self.rows, dim) = values, values.shape
        low = values.min(axis=0) if self.rows else np.zeros(dim, np.int64)
        bits = max((int(x).bit_length() for x in values.max(axis=0) - low), default=0) if self.rows else 0
        self.dropped, self.kept = max(0, bits - slices), min(bits, slices)
        coarse = ((values - low) >> self.dropped).astype(np.int64)
        plain = np.stack([bitmaps((coarse.T >> t & 1).astype(bool)) for t in range(self.kept)], axis=1) if self.kept else np.zeros((dim, 0, -(-self.rows // 64)), np.uint64)
        self.slices = np.stack([plain, ~plain])
        self.all = bitmaps(np.ones(self.rows, bool))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over attributes of |q_j| times its quantised (complemented) value, least first."""
        size = np.array([abs(int(x)) for x in query], object)
        sign = np.array([int(x < 0) for x in query])
        most = max((int(x).bit_length() for x in size), default=0)
        takes = [np.nonzero([x >> s & 1 for x in size])[0] for s in range(most)]
        columns: dict[int, list[np.ndarray]] = {}
        for s, chosen in enumerate(takes):
            for t in range(self.kept if len(chosen) else 0):
                columns.setdefault(s + t, []).append(self.slices[sign[chosen], chosen, t])
        out, c = [], 0
        while columns:
            parts = columns.pop(c, [])
            rows = np.concatenate(parts) if parts else self.all[None, :] * np.uint64(0)
            while len(rows) > 2:  # full adders: three bitmaps become one here and one in the next column
                k = len(rows) // 3
                x, y, z = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                half = x ^ y
                columns.setdefault(c + 1, []).append((x & y) | (half & z))
                rows = np.concatenate([half ^ z, rows[3 * k :]])
            if len(rows) == 2:
                columns.setdefault(c + 1, []).append((rows[0] & rows[1])[None, :])
                rows = (rows[0] ^ rows[1])[None, :]
            out.append(rows[0])
            c += 1
        return out

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Positions of all rows that can be among the k best."""
        if self.rows <= k:
            return np.arange(self.rows)
        sums = self.sums(query)
        among, left, least = self.all, k, 0
        for c in range(len(sums) - 1, -1, -1):
            ones = among & sums[c]
            count = int(np.bitwise_count(ones).sum())
            if count >= left:
                among, least = ones, least | 1 << c
            else:
                among, left = among & ~sums[c], left - count
        lost = sum(abs(int(x)) for x in query) * ((1 << self.dropped) - 1)
        floor = least - (lost >> self.dropped)
        above, equal = self.all & np.uint64(0), self.all
        if floor > 0:
            for c in range(len(sums) - 1, -1, -1):
                if floor >> c & 1:
                    equal = equal & sums[c]
                else:
                    above, equal = above | (equal & sums[c]), equal & ~sums[c]
        return positions(above | equal, self.rows)

    def best(self, query: np.ndarray, k: int, order: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows but one, ties in ``order``, by exact integers."""
        found = self.candidates(query, k + 1)
        found = found[found != left_out]
        rows, wide = self.values[found], query
        if rows.dtype != object and len(query) * max(1, int(np.abs(self.values).max(initial=0))) * max(1, int(np.abs(query).max(initial=0))) >= 1 << 62:
            rows, wide = rows.astype(object), query.astype(object)
        scores = rows @ wide if rows.shape[1] else np.zeros(len(found), np.int64)
        if scores.dtype == object:
            take = np.array(sorted(range(len(found)), key=lambda i: (-scores[i], order[found[i]]))[:k], np.int64)
        else:
            take = np.lexsort((order[found], -scores))[:k]
        return found[take], scores[take]


INDEX = "dim int, block long, n int, kind string, data binary, rows binary, ids binary, known binary"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of INDEX for each (dim, block) of rows sorted by dim and block."""
    name, held = None, []

    def made() -> pa.RecordBatch:
        values = np.concatenate([matrix(b.column("v"), name[0]) for b in held])
        ids = pa.concat_arrays([b.column("vec_id") for b in held])
        rows = np.concatenate([b.column("row_no").to_numpy() for b in held])
        kind, data = packed(values)
        plain = ids.fill_null(0).to_numpy().astype("<i8").tobytes()
        known = (~ids.is_null().to_numpy(zero_copy_only=False)).astype(np.uint8).tobytes()
        return pa.record_batch(
            [pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), pa.array([rows.astype("<i8").tobytes()], pa.binary()), pa.array([plain], pa.binary()), pa.array([known], pa.binary())],
            [c.split(" ")[0] for c in INDEX.split(", ")],
        )

    for batch in batches:
        keys = list(zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist()))
        heads = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        for a, b in zip(heads, [*heads[1:], len(keys)]):
            if keys[a] != name:
                if name is not None:
                    yield made()
                name, held = keys[a], []
            held.append(batch.slice(a, b - a))
    if name is not None:
        yield made()


def _searched(k: int):
    """A function over index rows, each followed by the chunks that meet it: each query's best rows of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = index = ids = known = rows = order = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                values = unpacked(row["kind"], row["data"], row["dim"], row["n"])
                own_ids, own_rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
                if not row["asks"]:
                    name, index = (row["dim"], row["place"]), Index(values)
                    ids, rows, known = own_ids, own_rows, np.frombuffer(row["known"], np.uint8).astype(bool)
                    order = np.argsort(np.lexsort((rows, ids, ~known)))
                    place = {int(r): at for at, r in enumerate(rows)}
                    continue
                if name != (row["dim"], row["place"]):
                    continue  # no row was dealt to this block
                parts = []
                for q in range(row["n"]):
                    at, scores = index.best(values[q], k, order, place.get(int(own_rows[q]), -1))
                    parts.append((np.repeat(own_ids[q], len(at)), np.repeat(own_rows[q], len(at)), at, scores.tolist()))
                at = np.concatenate([p[2] for p in parts]).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.concatenate([p[1] for p in parts])), pa.array(ids[at], mask=~known[at]), pa.array(rows[at]), pa.array([Decimal(min(max(s, -MOST_WIDE), MOST_WIDE)) for p in parts for s in p[3]], WIDE)],
                    ["query_id", "query_row", "vec_id", "row_no", "score"],
                )

    return run


def dealt(rows: DataFrame, size: int, label: str) -> tuple[DataFrame, DataFrame]:
    """INDEX rows of blocks of about ``size`` vectors, and (dim, count) of blocks: both written."""
    counts = written(rows.groupBy("dim").agg(F.expr(f"int(ceil(count(*) / {size}))").alias("count")), f"{label}-counts")
    block = F.pmod(F.xxhash64("row_no"), F.col("count")).alias("block")
    keyed = rows.join(counts, "dim").select("dim", block, "row_no", "vec_id", "v")
    return written(keyed.repartition("dim", "block").sortWithinPartitions("dim", "block", "row_no").mapInArrow(_indexed, INDEX), label), counts


def _as_long(score: Column) -> Column:
    return F.when(score > MOST_LONG, MOST_LONG).when(score < -MOST_LONG - 1, -MOST_LONG - 1).otherwise(score.cast("long"))


def top_k(vectors: DataFrame, asks: Column, k: int = 10, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asks`` holds, the k rows of largest inner product."""
    rows = written(integers(vectors), "slice-rows")
    index, blocks = dealt(rows, block, "slice-index")
    queries, chunks = dealt(rows.where(asks & F.col("vec_id").isNotNull()), chunk, "slice-queries")
    groups = chunks.select("dim", F.expr(f"int(ceil(count / {CHUNKS}))").alias("groups"))
    copies = index.join(groups, "dim").select(F.lit(False).alias("asks"), F.col("block").alias("place"), F.explode(F.expr("sequence(0, groups - 1)")).alias("group"), F.lit(-1).cast("long").alias("chunk"), *index.columns)
    asked = queries.join(blocks, "dim").select(F.lit(True).alias("asks"), F.explode(F.expr("sequence(0L, count - 1L)")).alias("place"), F.expr(f"int(block DIV {CHUNKS})").alias("group"), F.col("block").alias("chunk"), *index.columns)
    # compute, not bytes, sets the number of tasks: about four for each meeting of a block with a group of chunks
    meetings = blocks.join(groups, "dim").agg(F.sum(F.col("count").cast("long") * F.col("groups"))).head()[0] or 1
    met = copies.unionByName(asked).repartition(min(4 * meetings, MOST_TASKS), "dim", "place", "group").sortWithinPartitions("dim", "place", "group", "asks", "chunk")
    found = met.mapInArrow(_searched(k), "query_id long, query_row long, vec_id long, row_no long, score decimal(38,0)")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", _as_long(F.col("score")).alias("score"))
