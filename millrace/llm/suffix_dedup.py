"""Suffix-array dedup: longest previous factors mark what occurred before, and later copies go.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller doc_id, or
earlier in the same one. Strings never cross documents, and are judged on the input.

1. Whole copies meet by digest; of a text's copies only the first is searched, the others go whole (if long enough).
2. Each string of LENGTH bytes has an anchor: of its windows of ``GRAM`` bytes the first with the least hash. Equal
   strings have equal anchors at equal places, so a corpus-wide count of anchor hashes finds all strings that can
   occur twice, and only anchors that occur twice go on. What is counted names texts by digest, so copies count once.
3. Anchors that recur become contexts: the bytes around them and the range of starts whose anchor they are. Equal
   contexts of one anchor meet before and after the shuffle; all but the first are repeats as a whole.
4. The other contexts of an anchor meet in bounded blocks. A block's starts get a suffix array (prefix doubling up to
   LENGTH), previous and next smaller positions in suffix order, and from these the array of longest previous factors,
   capped at LENGTH. A start whose factor has LENGTH bytes occurred before.
5. An anchor with more occurrences than ``CROWD`` is split before it can fill a task: each of its starts becomes a
   context of its own, dealt by a hash of the string. Equal strings then meet as equal contexts, as in 3.
6. Starts become byte ranges per document, are merged, and cut from the text. Only texts with repeats move again.

Nulls count as empty texts. A null doc_id comes before all others; rows that repeat a doc_id are documents of their own,
in order of text: tables that have either are numbered first. A text of any length is one document: its bytes are held
once, as a block of its own where it is longer than a block. An empty table gives an empty result. Extra columns, of any
name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, text_bytes, written
from millrace.llm.rolling import sliding_min, window_hashes

LENGTH, GRAM = 100, 32
#: Occurrences of one anchor that a task takes as a group, and context bytes of a block.
CROWD, BLOCK = 20_000, 2 << 20
#: Bits of a place within a block; a text has less than 2 ** 31 bytes.
PLACE_BITS = 31
#: Anchors that a map task gathers before it sends them.
GATHER = 1_500_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, document, offset, low, high) of all anchors of a block of texts: the anchor at ``offset`` of a document
    is that of the strings that start from ``low`` to ``high``."""
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    hashes = window_hashes(data, GRAM)
    # the hash's high bits, then the place: the least is the first of the least, and tells its place. How many bits
    # are the hash's doesn't depend on the block, so that equal strings have equal anchors everywhere
    bits = np.uint64(PLACE_BITS)
    least = sliding_min(((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64), width)
    start = np.arange(len(least))
    room = np.zeros(len(least), bool)  # starts whose string stays within its text
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= LENGTH:
            room[a : b - LENGTH + 1] = True
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start, place = start[room], place[room]
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    head = np.nonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))[0]
    tail = np.append(head[1:], len(start)) - 1
    doc = np.searchsorted(offsets, start[head], side="right") - 1
    base = offsets[doc]
    return hashes[place[head]], doc, place[head] - base, start[head] - base, start[tail] - base


def _digests(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = text_bytes(block.column("text"))
    raw, edges = memoryview(data.tobytes()), offsets.tolist()
    return data, offsets, [hashlib.sha256(raw[a:b]).digest() for a, b in zip(edges, edges[1:])]


def _names(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, name) per row; the name is the start of the digest as a number."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            _, offsets, found = _digests(block)
            yield pa.record_batch([block.column("doc_id"), pa.array(np.diff(offsets)), pa.array(found, pa.binary()), pa.array(_names(found))], ["doc_id", "n_bytes", "digest", "name"])

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_bytes long, digest binary, name long")


def _packed_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, texts, offsets): the anchors of a map task by bucket of the hash; ``texts`` are digests."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, parts = 0, []
        for block in blocks(batches):
            data, offsets, digests = _digests(block)
            names = _names(digests)
            found, doc, at, _, _ = anchors(data, offsets)
            parts.append((found, names[doc], at.astype(np.int32)))
            have += len(found)
            if have >= GATHER:
                yield from _deal(parts, buckets)
                have, parts = 0, []
        if have:
            yield from _deal(parts, buckets)

    return docs.select("text").mapInArrow(pack, "bucket int, hashes binary, texts binary, offsets binary")


def _deal(parts: list, buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, docs, offsets = (np.concatenate(x) for x in zip(*parts))
    bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    hashes, docs, offsets, bucket = hashes[order], docs[order], offsets[order], bucket[order]
    heads = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0].tolist()
    tails = heads[1:] + [len(bucket)]
    for a in range(0, len(heads), 64):
        spans = list(zip(heads[a : a + 64], tails[a : a + 64]))
        yield pa.record_batch(
            [pa.array([int(bucket[x]) for x, _ in spans], pa.int32())]
            + [pa.array([values[x:y].tobytes() for x, y in spans], pa.binary()) for values in (hashes, docs, offsets)],
            ["bucket", "hashes", "texts", "offsets"],
        )


def _recurring(packed: DataFrame, crowded: int = CROWD) -> DataFrame:
    """(name, offsets, crowds): by text, the anchors whose hash occurs more than once, and those of crowds."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for h, d, o in zip(*(batch.column(c).to_pylist() for c in ("hashes", "texts", "offsets"))):
                parts.append((np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64), np.frombuffer(o, np.int32)))
        if not parts:
            return
        hashes, texts, offsets = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(hashes)
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        chosen = order[np.append(same, False) | np.append(False, same)]
        hashes, texts, offsets = hashes[chosen], texts[chosen], offsets[chosen]
        # a text's copies have the same digest and offset and count once
        order = np.lexsort((offsets, texts, hashes))
        hashes, texts, offsets = hashes[order], texts[order], offsets[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1]) | (offsets[1:] != offsets[:-1]))[: len(hashes)]
        hashes, texts, offsets = hashes[new], texts[new], offsets[new]
        heads = np.nonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])[0]
        sizes = np.diff(np.append(heads, len(hashes)))
        size = np.repeat(sizes, sizes)
        texts, offsets, crowd = texts[size > 1], offsets[size > 1], size[size > 1] > crowded
        order = np.lexsort((offsets, texts))
        texts, offsets, crowd = texts[order], offsets[order], crowd[order]
        heads = np.nonzero(np.append(True, texts[1:] != texts[:-1])[: len(texts)])[0].tolist()
        tails = heads[1:] + [len(texts)]
        for a in range(0, len(heads), 20_000):
            spans = list(zip(heads[a : a + 20_000], tails[a : a + 20_000]))
            yield pa.record_batch(
                [
                    pa.array(texts[[x for x, _ in spans]]),
                    pa.array([offsets[x:y].tobytes() for x, y in spans], pa.binary()),
                    pa.array([offsets[x:y][crowd[x:y]].tobytes() for x, y in spans], pa.binary()),
                ],
                ["name", "offsets", "crowds"],
            )

    return packed.repartition("bucket").mapInArrow(meet, "name long, offsets binary, crowds binary")


def _contexts(found: DataFrame) -> DataFrame:
    """(anchor, doc_id, low, high, context) of the recurring anchors of (doc_id, text, offsets, crowds).

    Of a block's equal contexts of one anchor only the first keeps its bytes; the others are repeats for certain, and
    are dealt by document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, offsets = text_bytes(block.column("text"))
            found, doc, at, low, high = anchors(data, offsets)
            keep, crowd = np.zeros(len(found), bool), np.zeros(len(found), bool)
            edges = np.searchsorted(doc, np.arange(block.num_rows + 1)).tolist()
            for chosen, column in ((keep, "offsets"), (crowd, "crowds")):
                for i, lists in enumerate(block.column(column).to_pylist()):
                    a, b = edges[i], edges[i + 1]
                    chosen[a:b] = np.isin(at[a:b], np.frombuffer(b"".join(lists), np.int32))
            found, doc, low, high, crowd = found[keep], doc[keep], low[keep], high[keep], crowd[keep]
            # each start of a crowd's anchor is a context of its own, with the string's hash for an anchor
            count = high - low + 1
            some = np.repeat(np.nonzero(crowd)[0], count[crowd])
            single = low[some] + np.arange(len(some)) - np.repeat(np.cumsum(count[crowd]) - count[crowd], count[crowd])
            whole = window_hashes(data, LENGTH)
            own = whole[offsets[doc[some]] + single] if len(some) else found[:0]
            found, doc = np.concatenate([found[~crowd], own]), np.concatenate([doc[~crowd], doc[some]])
            low, high = np.concatenate([low[~crowd], single]), np.concatenate([high[~crowd], single])
            raw, base = memoryview(data.tobytes()), offsets[doc]
            keys = block.column("doc_id").to_numpy()[doc]
            order = np.lexsort((low, keys))
            seen: set = set()
            for a in range(0, len(order), 20_000):
                part = order[a : a + 20_000]
                texts, dealt = [], found[part].view(np.int64).copy()
                for i, (h, x, y) in enumerate(zip(found[part].tolist(), (base + low)[part].tolist(), (base + high + LENGTH)[part].tolist())):
                    context = bytes(raw[x:y])
                    if (h, context) in seen:
                        context, dealt[i] = None, keys[part[i]]
                    else:
                        seen.add((h, context))
                    texts.append(context)
                yield pa.record_batch(
                    [pa.array(dealt), pa.array(keys[part]), pa.array(low[part].astype(np.int32)), pa.array(high[part].astype(np.int32)), pa.array(texts, pa.binary())],
                    ["anchor", "doc_id", "low", "high", "context"],
                )

    return found.mapInArrow(cut, "anchor long, doc_id long, low int, high int, context binary")


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank of every place among the strings of that width), by prefix doubling from 8 bytes to ``length``;
    equal strings have equal ranks. The last ranks, ties by position, are the suffix array's order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | padded[i : i + n]
    have = 8
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    levels = [(have, rank.astype(np.int32))]
    while have < length:
        step = min(have, length - have)
        shifted = np.zeros(n, np.int64)
        shifted[: n - step] = rank[step:] + 1
        rank = np.unique(rank * np.int64(n + 2) + shifted, return_inverse=True)[1].astype(np.int64)
        have += step
        levels.append((have, rank.astype(np.int32)))
    return levels


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the longest common prefix, capped at ``length``, of the strings at each a and b: whole widths as far
    as ranks agree, from the greatest down, then bytes."""
    out = np.zeros(len(a), np.int64)
    equal = levels[-1][1][a] == levels[-1][1][b]
    out[equal] = length
    rest = np.nonzero(~equal)[0]
    at, other, have = a[rest], b[rest], np.zeros(len(rest), np.int64)
    n = len(data)
    for width, rank in levels[-2::-1]:
        x, y = at + have, other + have
        same = (x < n) & (y < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        have += width * same
    going = np.ones(len(rest), bool)
    for _ in range(8):
        x, y = at + have, other + have
        going &= (x < n) & (y < n)
        going[going] = data[x[going]] == data[y[going]]
        have += going
    out[rest] = np.minimum(have, length)
    return out


def smaller_before(position: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller position, or -1; all places jump at once."""
    n = len(position)
    link = np.arange(-1, n - 1)
    active = np.nonzero(link >= 0)[0]
    while len(active):
        worse = position[link[active]] > position[active]
        active = active[worse]
        link[active] = link[link[active]]
        active = active[link[active] >= 0]
    return link


def previous_factors(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of each start, capped at ``length``: the longest string at it that also starts at an
    earlier position. The neighbours in suffix order with a smaller position, before and after, have the longest common
    prefixes with it among all earlier starts."""
    levels = suffix_ranks(data, length)
    rank = levels[-1][1][starts]
    order = np.lexsort((position, rank))
    where, at = position[order], starts[order]
    before = smaller_before(where)
    after = len(where) - 1 - smaller_before(where[::-1])[::-1]
    found = np.zeros(len(starts), np.int64)
    for near, some in ((before, np.nonzero(before >= 0)[0]), (after, np.nonzero(after < len(where))[0])):
        found[some] = np.maximum(found[some], common_prefixes(data, levels, at[some], at[near[some]], length))
    out = np.zeros(len(starts), np.int64)
    out[order] = found
    return out


def _runs(doc, start, repeated) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of bytes that repeated starts cover, starts being in order within their contexts."""
    doc, start = doc[repeated], start[repeated]
    if not len(doc):
        return doc, start, start
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
    head = np.nonzero(new)[0]
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], start[tail] + LENGTH


def _search(contexts: DataFrame) -> DataFrame:
    """(doc_id, start, end): ranges covered by strings that occur earlier."""

    def rows(doc, start, end) -> Iterator[pa.RecordBatch]:
        if len(doc):
            yield pa.record_batch([pa.array(doc), pa.array(start), pa.array(end)], ["doc_id", "start", "end"])

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, doc, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc_id", "low", "high"))
        context = table.column("context").chunk(0) if table.num_rows else table.column("context").combine_chunks()
        code = context.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
        # rows are in order, so the first of equal contexts of an anchor is the earliest
        order = np.lexsort((np.arange(len(code)), code, anchor))
        equal = (code[order][1:] == code[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
        again = np.zeros(len(code), bool)
        again[order[1:]] = equal
        again |= code < 0
        yield from rows(doc[again], low[again], high[again] + LENGTH)
        left = np.nonzero(~again)[0]
        different = anchor[left][1:] != anchor[left][:-1]
        several = ~(np.append(True, different) & np.append(different, True))[: len(left)]
        left = left[several]
        if not len(left):
            return
        data, offsets = text_bytes(context.take(pa.array(left)))
        doc, low, high = doc[left], low[left], high[left]
        count = high - low + 1
        row = np.repeat(np.arange(len(left)), count)
        at = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        position = np.empty(len(row), np.int64)
        position[np.lexsort((at, doc[row]))] = np.arange(len(row))
        factors = previous_factors(data, offsets[row] + at - low[row], position, LENGTH)
        yield from rows(*_runs(doc[row], at, factors >= LENGTH))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            a = 0
            while a < len(anchor):
                # up to BLOCK bytes, then on to the end of the anchor's group
                sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("context")), 0).to_numpy()[a:])
                b = a + int(np.searchsorted(sizes, BLOCK - size)) + 1
                while b < len(anchor) and anchor[b] == anchor[b - 1]:
                    b += 1
                if size >= BLOCK:
                    b = a
                    while b < len(anchor) and anchor[b] == last:
                        b += 1
                    if b == a:
                        yield from solve(held)
                        held, size = [], 0
                        continue
                b = min(b, len(anchor))
                held.append(batch.slice(a, b - a))
                size += int(sizes[b - a - 1])
                last, a = anchor[b - 1], b
        if held:
            yield from solve(held)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "low")
    return dealt.mapInArrow(search, "doc_id long, start long, end long")


def _cut(rows: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept_sha256) of (doc_id, text, spans), and ``kept binary`` if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, offsets = text_bytes(block.column("text"))
            raw, edges = memoryview(data.tobytes()), offsets.tolist()
            removed, runs, digests, kept = [], [], [], []
            for a, b, spans in zip(edges, edges[1:], block.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for x, y in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                ends = [0] + [y for _, y in merged]
                rest = b"".join([raw[a + y : a + x] for y, x in zip(ends, [x for x, _ in merged] + [b - a])])
                removed.append(b - a - len(rest))
                runs.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.record_batch(
                [block.column("doc_id"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept, pa.binary())] * texts,
                ["doc_id", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts,
            )

    return rows.mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with numbers in order of (doc_id, text), for tables whose doc_ids are null or repeat."""
    ordered = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    return written(ordered.select(F.col("doc_id").alias("given_id"), "text", F.monotonically_increasing_id().alias("doc_id")), "numbered")


def repeats(docs: DataFrame, crowded: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For unique doc_ids: (doc_id, n_bytes, digest, whole) of all rows, where ``whole`` marks later copies of a text;
    (doc_id, text) of the texts that were searched; (doc_id, spans) of the repeated ranges found in them."""
    rows = docs.select("doc_id", "text")
    info = written(_documents(rows), "texts")
    first = written(info.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")  # the join's exchanges can then be split
    info = written(info.join(first, "digest").select("doc_id", "n_bytes", "digest", "name", (F.col("doc_id") != F.col("first")).alias("whole")), "texts")

    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    recurring = written(_recurring(_packed_anchors(rows, buckets), crowded), "anchors")
    names = info.where("NOT whole").select("doc_id", "name")
    lists = recurring.groupBy("name").agg(F.collect_list("offsets").alias("offsets"), F.collect_list("crowds").alias("crowds"))
    wanted = lists.join(names, "name").select("doc_id", "offsets", "crowds")
    searched = written(rows.join(wanted, "doc_id"), "searched")
    ranges = _search(_contexts(searched))
    spans = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return info, searched.select("doc_id", "text"), spans


def without_repeats(docs: DataFrame, crowded: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    plain = docs.select("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).head()
    rows = docs if plain["n"] == plain["ids"] else _numbered(docs)
    info, searched, spans = repeats(rows, crowded)
    changed = _cut(searched.join(spans, "doc_id")).withColumnRenamed("kept_sha256", "rest")
    gone = F.col("whole") & (F.col("n_bytes") >= LENGTH)
    found = info.join(changed, "doc_id", "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    if rows is docs:
        return found
    return found.join(rows.select("doc_id", "given_id"), "doc_id").select(F.col("given_id").alias("doc_id"), *found.columns[1:])


def cut_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): what is left of each text with unique doc_id, as bytes."""
    info, _, spans = repeats(docs)
    whole = info.where(F.col("whole") & (F.col("n_bytes") >= LENGTH)).select(
        "doc_id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans")
    )
    marked = docs.select("doc_id", "text").join(spans.unionByName(whole), "doc_id", "left")
    return _cut(marked, texts=True).select("doc_id", "kept")
