"""N-gram Jaccard join with PartEnum signatures, and the components that its links form.

A text's set holds hashes of its distinct word 5-grams. Sets are joined within size bands: band j covers sizes from
2**j up to 4/3 of 2**(j + 1), so that a pair always meets in the band of its smaller set; sets near a border have
signatures in two bands. In a band the feature domain is split into ``n1`` first-level parts, and each of those into
``SECOND`` second-level parts, by hash. Of each first-level part a set emits, for every subset of SECOND - MAY_DIFFER
second-level parts, a hash of its features in that subset, if there are any (PartEnum).

Why similar sets x, y share a signature: they differ in at most d features, d depending on the size and the band
(``differing``). Call a part full for a set if more than MAY_DIFFER of its second-level parts hold features, so that no
subset is empty, and good if at most MAY_DIFFER features differ in it and it is full for x or y: then some subset is
equal in both and not empty. Parts have one order. A set takes them in that order until it has met need = d // (MAY_DIFFER
+ 1) + 1 that are full for it. Before the first good part all parts that are full for it differ in more than MAY_DIFFER
features, so they are fewer than need, and it takes that good part too. If either set has need full parts, a good part
exists. Sets with fewer (small ones, mostly) emit, besides all their parts, their first features in the order of a
hash, as many as must hold a common one; two such sets meet there. The promise holds for every size.

Signatures name sets, not documents: equal sets meet as one before anything is compared, however many copies there
are. Each set takes some full parts more than it needs, its slack: by the same count two similar sets then share more
signatures than the lesser slack. So a signature that more than ``CROWD`` sets share needs a look only for sets with more crowded signatures
than their slack (sets that are mostly common passages, or families of edited copies). Crowds with the same least
member are one family. A family is compared in blocks of bounded size, a task for each pair of blocks, by bitmaps of the
features that its members share: each member first with one set of every component, then only with members of other
components. No row per pair leaves a task, only links that join components. Nothing is capped.

Candidates that share fewer signatures than the slack demands are no candidates. Of the rest, a feature that no other
candidate set has can't be common: a pair whose sizes, less such features, leave too few for the threshold is no
candidate either. What remains is verified on whole feature sets. Features are 64-bit hashes of the words' bytes; sets carry 128 bits of
identity.

Nulls and empty texts have empty sets, which link with nothing; a null doc_id is never a representative of others but
keeps its own row. Repeated rows are copies. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, numbered, one_row_of_each, text_bytes, worker_state, written
from millrace.llm.components import components
from millrace.llm.rolling import BASE, BYTE_VALUES, combine, mixed

NGRAM = 5
#: Similarity as a fraction: links have UNION * intersection >= SHARE * union.
SHARE, UNION = 75, 100
#: Second-level parts of a first-level part, and how many of them may differ.
SECOND, MAY_DIFFER = 3, 1
#: Features of a band's smallest sets for 10 first-level parts.
FEATURES_FOR_TEN = 16
#: Sets that may share a signature before it counts as crowded, and signatures beyond the promise as a part of the size.
CROWD = 16
SLACK, SLACK_OF = 1, 80
#: Sets in a block of a family, and features that its bitmaps hold; beyond them, lists of sets by feature are counted.
BLOCK_SETS, BITS = 1500, 1 << 16
#: Hash buckets of doc_ids that a broadcast filter may hold.
BUCKETS = 1 << 20
#: Signatures that a map task gathers before it sends them.
GATHER = 800_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i below n at least."""
    state = worker_state("jaccard_join")
    if "powers" not in state or len(state["powers"][0]) < n:
        size = max(n, 1 << 21)
        inverse = pow(BASE, -1, 1 << 64)
        state["powers"] = []
        for base in (BASE, inverse):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            state["powers"].append(np.multiply.accumulate(steps))
    return state["powers"][0], state["powers"][1]


def feature_sets(column: pa.Array, ngram: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct feature hashes of each text of a block."""
    data, offsets = text_bytes(column)
    n = len(data)
    inside = ~_BLANK[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    up, down = _powers(n + 1)
    sums = np.append(np.uint64(0), np.cumsum(BYTE_VALUES[_LOWER[data]] * up[:n]))
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    grams = mixed(combine(words, ngram))
    edges = np.searchsorted(starts, offsets).tolist()
    found = []
    for a, b in zip(edges, edges[1:]):
        if b - a >= ngram:
            found.append(np.unique(grams[a : b - ngram + 1]))
        elif b > a:
            found.append(mixed(combine(words[a:b], b - a) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def identity(features: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(features.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def reach(size: int, share: int = SHARE, union: int = UNION) -> int:
    """Most features in which a set of ``size`` differs from a similar one."""
    return size * (union - share) // share


def slack(size: int) -> int:
    return size * SLACK // SLACK_OF


def differing(size, band: int, share: int = SHARE, union: int = UNION):
    """Most features in which a set of ``size`` (or of each size of an array) and a similar one differ, the smaller of
    both being of the band's own sizes: similar sets of a and b features differ in (a + b) * (union - share) /
    (union + share) at most."""
    most = 2 ** (band + 1) - 1
    return np.where(size <= most, size * (union - share) // share, (most + size) * (union - share) // (union + share))


SUBSETS = list(combinations(range(SECOND), SECOND - MAY_DIFFER))


def _distinct_subsets() -> np.ndarray:
    """[which second-level parts hold features, as bits][subset]: whether to emit it, equal projections once."""
    table = np.zeros((1 << SECOND, len(SUBSETS)), bool)
    for bits in range(1 << SECOND):
        seen = {0}
        for i, subset in enumerate(SUBSETS):
            own = bits & sum(1 << k for k in subset)
            table[bits, i] = own not in seen
            seen.add(own)
    return table


DISTINCT = _distinct_subsets()


def signatures_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all sets of a block, band by band."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    level = np.frexp(sizes)[1].astype(np.int64) - 1
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    second, low = np.uint64(SECOND), np.uint64(0xFFFFFFFF)
    for band in range(int(level.max()) + 1 if len(level) else 0):
        rows = np.nonzero((level == band) | ((level == band + 1) & (sizes * SHARE < 2 ** (band + 1) * UNION)))[0]
        if not len(rows):
            continue
        n, salt = sizes[rows], mixed(np.array([band + 1], np.uint64))
        spread, owner = mixed(np.concatenate([sets[r] for r in rows]) ^ salt), np.repeat(np.arange(len(rows)), n)
        n1 = max(1, 2**band * 10 // FEATURES_FOR_TEN)
        cell = ((spread >> np.uint64(32)) % np.uint64(n1)) * second + (spread & low) % second + owner.astype(np.uint64) * np.uint64(n1 * SECOND)
        key = (cell << np.uint64(32)) | (mixed(spread) >> np.uint64(32))
        key.sort()
        cell = key >> np.uint64(32)
        heads = np.nonzero(np.append(True, cell[1:] != cell[:-1]))[0]
        sums, cell = np.add.reduceat(mixed(key & low), heads), cell[heads].astype(np.int64)
        part = cell // SECOND
        new = np.append(True, part[1:] != part[:-1])
        row, part = np.cumsum(new) - 1, part[new]
        content, held = np.zeros((len(part), SECOND), np.uint64), np.zeros((len(part), SECOND), bool)
        content[row, cell % SECOND], held[row, cell % SECOND] = sums, True
        own, name = part // n1, mixed((part % n1).astype(np.uint64) + salt)
        full = held.sum(axis=1) > MAY_DIFFER
        ends = np.cumsum(full)
        edges = np.searchsorted(own, np.arange(len(rows) + 1))
        before = ends - full
        start = before[edges[:-1]]
        need = differing(n, band) // (MAY_DIFFER + 1) + 1 + n * SLACK // SLACK_OF
        taken = before - start[own] < need[own]
        emitted = DISTINCT[held @ (1 << np.arange(SECOND))] & taken[:, None]
        for i, subset in enumerate(SUBSETS):
            some = emitted[:, i]
            owners.append(rows[own[some]])
            found.append(mixed(content[some][:, subset].sum(axis=1) + name[some] * np.uint64(BASE)))
        sparse = ends[edges[1:] - 1] - start < need
        if sparse.any():
            of_sparse = sparse[owner]
            spread, owner = mixed(spread[of_sparse] ^ np.uint64(BASE)), owner[of_sparse]
            order = np.lexsort((spread, owner))
            spread, owner = spread[order], owner[order]
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            first = nth < (n * (UNION - SHARE) // UNION + 1 + n * SLACK // SLACK_OF)[owner]
            owners.append(rows[owner[first]])
            found.append(spread[first])
    return np.concatenate(owners), np.concatenate(found)


def signatures(features: np.ndarray) -> np.ndarray:
    """Signatures of one set."""
    return np.unique(signatures_of([features])[1])


def sketch(features: np.ndarray) -> bytes:
    """How many features fall to each range of hashes, some four to eight a range; empty if a count needs two bytes.

    The ranges of a smaller set are pairs of those of a set of the next level, so that sketches fold onto each other."""
    bits = max(0, len(features).bit_length() - 3)
    counts = np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(features)])
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n_a, n_b, x, y) the pairs whose sketches x and y allow a link: counts of a range that differ by d mean
    d features at least in which the sets differ."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "x", "y"))):
            if not x or not y:
                keep.append(True)
                continue
            p, q = sorted((np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)), key=len)
            differ = int(np.abs(p - q.reshape(len(p), -1).sum(axis=1)).sum())
            keep.append(differ * (UNION + SHARE) <= (UNION - SHARE) * (n + m))
        columns = ["a", "b", "n_a", "n_b"]
        yield pa.record_batch([batch.column(c) for c in columns], columns).filter(pa.array(keep, pa.bool_()))


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, key2, sketch): size, identity and sketch of each document's set."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = feature_sets(block.column("text"))
            keys = [identity(x) for x in sets]
            yield pa.record_batch(
                [block.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())],
                ["doc_id", "n", "key", "key2", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(summarise, "doc_id long, n long, key long, key2 long, sketch binary")


_PACKED = "bucket int, hashes binary, keys binary, runs binary"


def _dealt(hashes: list[np.ndarray], key: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a hash, of which 40 bits and the bucket stay, and a key, packed by bucket of the hash. A bucket's keys are
    sorted, each is sent once with its number, as the difference to the one before; equal bytes of these stand together.
    Hashes that become equal only add candidates, which are verified."""
    pair = np.stack([np.concatenate(hashes), np.concatenate(key)])
    bucket = (pair[0] >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((pair[1], bucket))
    pair, bucket = pair[:, order], bucket[order]
    edge = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
    heads = np.nonzero(edge)[0]
    run = np.nonzero(edge | np.append(True, pair[1, 1:] != pair[1, :-1])[: len(bucket)])[0]
    runs = np.diff(np.append(run, len(bucket))).astype("<u4")
    own = np.append(np.searchsorted(run, heads), len(run)).tolist()
    names, heads = pair[1, run], [*heads.tolist(), len(bucket)]
    for part in range(0, len(heads) - 1, 64):
        some = range(part, min(part + 64, len(heads) - 1))
        low = [(pair[0, heads[i] : heads[i + 1]] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for i in some]
        high = [((pair[0, heads[i] : heads[i + 1]] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes() for i in some]
        apart = [np.diff(names[own[i] : own[i + 1]], prepend=np.uint64(0)) for i in some]
        yield pa.record_batch(
            [
                pa.array([int(bucket[heads[i]]) for i in some], pa.int32()),
                pa.array([x + y for x, y in zip(low, high)], pa.binary()),
                pa.array([x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in apart], pa.binary()),
                pa.array([runs[own[i] : own[i + 1]].tobytes() for i in some], pa.binary()),
            ],
            ["bucket", "hashes", "keys", "runs"],
        )


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a task's packed rows. The bucket is part of the hash, as one task may read several."""
    hashes, key = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for batch in batches:
        for bucket, row, keys, runs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "hashes", "keys", "runs"))):
            n = len(row) // 5
            high = np.frombuffer(row, np.uint8, n, n * 4).astype(np.uint64) | (np.uint64(bucket & 0xFFFFFF) << np.uint64(8))
            hashes.append(np.frombuffer(row, "<u4", n).astype(np.uint64) | (high << np.uint64(32)))
            names = np.cumsum(np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)
            key.append(np.repeat(names, np.frombuffer(runs, "<u4")))
    return np.concatenate(hashes), np.concatenate(key)


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures of the sets of a map task with the sets' keys, by bucket."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature, key, have, seen = [], [], 0, set()
        for block in blocks(batches):
            sets, names = [], []
            for features in feature_sets(block.column("text")):
                own = identity(features)[0]
                if own not in seen and len(features):
                    seen.add(own)
                    sets.append(features)
                    names.append(own)
            if sets:
                owner, found = signatures_of(sets)
                signature.append(found)
                key.append(np.array(names, np.int64).view(np.uint64)[owner])
                have += len(found)
            if have >= GATHER:
                yield from _dealt(signature, key, buckets)
                signature, key, have = [], [], 0
            if len(seen) > 100_000:
                seen.clear()
        if have:
            yield from _dealt(signature, key, buckets)

    return docs.select("text").mapInArrow(pack, _PACKED)


def _met(packed: DataFrame, buckets: int) -> DataFrame:
    """(a, b, shared, crowded): pairs of sets that share signatures, and how many; where ``crowded`` is set, a is a
    signature and b a set that has it."""

    def rows(a, b, shared, crowded: bool) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(a), 100_000):
            own = slice(first, first + 100_000)
            yield pa.record_batch(
                [pa.array(a[own].view(np.int64)), pa.array(b[own].view(np.int64)), pa.array(shared[own]), pa.array(np.full(len(a[own]), crowded))],
                ["a", "b", "shared", "crowded"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature, key = _gathered(batches)
        if not len(signature):
            return
        order = np.argsort(signature)
        signature, key = signature[order], key[order]
        # only signatures that occur again matter
        same = signature[1:] == signature[:-1]
        again = np.append(same, False) | np.append(False, same)
        signature, key = signature[again], key[again]
        order = np.lexsort((key, signature))
        signature, key = signature[order], key[order]
        new = np.append(True, (signature[1:] != signature[:-1]) | (key[1:] != key[:-1]))[: len(key)]
        signature, key = signature[new], key[new]
        heads = np.nonzero(np.append(True, signature[1:] != signature[:-1])[: len(key)])[0]
        sizes = np.diff(np.append(heads, len(key)))
        size = np.repeat(sizes, sizes)
        crowd = size > CROWD
        yield from rows(signature[crowd], key[crowd], np.zeros(int(crowd.sum()), np.int64), True)
        signature, key = signature[~crowd & (size > 1)], key[~crowd & (size > 1)]
        pairs = []
        for step in range(1, CROWD):
            hit = np.nonzero(signature[step:] == signature[:-step])[0]
            if not len(hit):
                break
            pairs.append(np.stack([key[hit], key[hit + step]]))
        if pairs:
            a, b = np.concatenate(pairs, axis=1)
            a, b = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            heads = np.nonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[0]
            yield from rows(a[heads], b[heads], np.diff(np.append(heads, len(a))), False)

    return packed.repartitionById(buckets, "bucket").mapInArrow(meet, "a long, b long, shared long, crowded boolean")


def _only(rows: DataFrame, column: str, keys: DataFrame, label: str) -> DataFrame:
    """``rows`` whose ``column`` may be among ``keys`` (one column of its name): a filter of BUCKETS hash buckets at
    most, whatever the input's size, so broadcast; rows outside them need no shuffle."""
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")
    buckets = written(keys.select(bucket.alias("__bucket")).distinct(), label)
    return rows.withColumn("__bucket", bucket).join(F.broadcast(buckets), "__bucket", "left_semi").drop("__bucket")


def _stored_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, features) of the sets named in ``wanted`` (doc_id, key), from whole texts."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = feature_sets(block.column("text"))
            yield pa.record_batch(
                [pa.array([identity(x)[0] for x in sets], pa.int64()), block.column("key"), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["own", "key", "features"],
            )

    chosen = _only(docs.select("doc_id", "text"), "doc_id", wanted.select("doc_id"), "wanted-buckets").join(wanted, "doc_id")
    found = chosen.select("key", "text").mapInArrow(store, "own long, key long, features binary").where("own = key")
    return found.select("key", "features")


def _shared_sizes(sets: DataFrame, buckets: int) -> DataFrame:
    """(key, alone): how many features of each set no other of these sets has."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                lists = [np.frombuffer(x, np.uint64) for x in some.column("features").to_pylist()]
                yield from _dealt([np.concatenate(lists)], [np.repeat(some.column("key").to_numpy().view(np.uint64), [len(x) for x in lists])], buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, key = _gathered(batches)
        order = np.argsort(feature)
        feature, key = feature[order], key[order]
        differs = np.append(True, feature[1:] != feature[:-1])
        alone = (differs & np.append(differs[1:], True))[: len(key)]
        names, n = np.unique(key[alone], return_counts=True)
        bucket = (mixed(names) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        names, n, bucket = names[order], n[order].astype("<u4"), bucket[order]
        heads = np.nonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])[0].tolist()
        spans = list(zip(heads, heads[1:] + [len(bucket)]))
        yield pa.record_batch(
            [pa.array([int(bucket[x]) for x, _ in spans], pa.int32())] + [pa.array([v[x:y].tobytes() for x, y in spans], pa.binary()) for v in (names, n)],
            ["bucket", "keys", "counts"],
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, "<u4")]
        for batch in batches:
            keys += [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            counts += [np.frombuffer(x, "<u4") for x in batch.column("counts").to_pylist()]
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts), len(names)).astype(np.int64)
        yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(sums)], ["key", "alone"])

    packed = sets.select("key", "features").mapInArrow(pack, _PACKED)
    # a set's features are counted in many buckets: its counts travel packed, so that rows are sets, not sets times buckets
    parts = packed.repartitionById(buckets, "bucket").mapInArrow(count, "bucket int, keys binary, counts binary")
    return parts.repartitionById(buckets, "bucket").mapInArrow(total, "key long, alone long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 0
                if min(len(p), len(q)) * UNION >= SHARE * max(len(p), len(q)):
                    merged = np.sort(np.concatenate([p, q]))
                    common = int((merged[1:] == merged[:-1]).sum())
                keep.append(UNION * common >= SHARE * (len(p) + len(q) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _only(sets, "key", pairs.select(F.explode(F.array("a", "b")).alias("key")), "pair-buckets")
    left = sets.select(F.col("key").alias("a"), F.col("features").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("features").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(verify, "a long, b long")


def _overlaps(lists: list[np.ndarray]):
    """A function (i, others) -> sizes of the intersections of list i with others, by bitmaps where they are small."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat, code, df = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    rank = np.cumsum(df > 1) - 1  # features of one set only are in no intersection
    owner = np.repeat(np.arange(len(lists)), sizes)
    keep = df[code] > 1
    owner, code = owner[keep], rank[code[keep]]
    width = int((df > 1).sum())
    del flat
    if width <= BITS:
        dense = np.zeros((len(lists), -(-max(width, 1) // 64) * 8), np.uint8)
        np.bitwise_or.at(dense, (owner, code >> 3), (1 << (code & 7)).astype(np.uint8))
        bits = dense.view(np.uint64)
        return lambda i, others: np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
    order = np.argsort(code, kind="stable")
    sets_of, ends = owner[order], np.cumsum(np.bincount(code, minlength=width))
    own_ends = np.cumsum(np.bincount(owner, minlength=len(lists)))

    def count(i, others):
        own = code[own_ends[i - 1] if i else 0 : own_ends[i]]
        met = [sets_of[ends[c - 1] if c else 0 : ends[c]] for c in own.tolist()]
        return np.bincount(np.concatenate(met) if met else sets_of[:0], minlength=len(lists))[others]

    return count


def _compared(rows: pa.Table) -> pa.Table:
    """Links that join components, of one block or between the two blocks of a pair."""
    key, n, most = (rows.column(c).to_numpy() for c in ("key", "n", "most"))
    side, root = rows.column("block").to_numpy(), np.arange(rows.num_rows)
    across = side.min() != side.max()
    if rows.column("low")[0].as_py() != rows.column("high")[0].as_py() and not across:
        return pa.table({"a": key[:0], "b": key[:0]})
    overlap = _overlaps([np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("features").combine_chunks()])
    left, right = [], []

    def test(i: int, others: np.ndarray) -> None:
        common = overlap(i, others)
        for j in others[UNION * common >= SHARE * (n[i] + n[others] - common)].tolist():
            if root[i] != root[j]:
                left.append(key[i])
                right.append(key[j])
                root[root == root[i]] = root[j]

    for i in range(1, len(key)):
        limit = np.minimum(most[i], most[:i])
        able = UNION * limit >= SHARE * (n[i] + n[:i] - limit)
        if across:
            able &= side[:i] != side[i]
        others = np.nonzero(able & (root[:i] != root[i]))[0]
        if len(others):
            test(i, others[np.unique(root[others], return_index=True)[1]])
            others = others[root[others] != root[i]]
        if len(others):
            test(i, others)
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _family_links(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect families: crowds (signature, key, n, most) whose least members agree."""
    heads = crowds.groupBy("signature").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    family = written(crowds.join(heads.select("signature", "head"), "signature").select("head", "key", "n", "most").distinct(), "families")
    blocks = family.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    dealt = family.join(blocks, "head").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("head", "key", "n", "most", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    sets = _only(sets, "key", family.select("key"), "family-buckets")
    return dealt.join(sets, "key").groupBy("head", "low", "high").applyInArrow(_compared, "a long, b long")


def similarity_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: the component is the least doc_id that links reach."""
    spark = docs.sparkSession
    info = written(summaries(docs), "sets")
    owners = written(
        info.where("n > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "set-owners"
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = written(_met(_packed(docs, buckets), buckets), "met")
    pairs = met.where("NOT crowded").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = written(pairs, "pairs")
    # crowded signatures, of sets that have more of them than their slack
    crowded = met.where("crowded").select(F.col("a").alias("signature"), F.col("b").alias("key")).distinct()
    crowded = written(crowded, "crowded")
    per_set = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("crowds"))
    sizes = owners.groupBy("key").agg(F.max("n").alias("n"))
    counts = written(sizes.join(per_set, "key", "left").select("key", "n", F.coalesce("crowds", F.lit(0)).alias("crowds")), "set-sizes")
    one = counts.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("crowds").alias("crowds_a"))
    two = counts.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("crowds").alias("crowds_b"))
    # similar sets share more signatures than the smaller one's slack; how many crowded ones they share is not known yet
    enough = F.col("shared") + F.least("crowds_a", "crowds_b") > F.floor(F.least("n_a", "n_b") * SLACK / SLACK_OF)
    near_size = UNION * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b")
    pairs = written(pairs.join(one, "a").join(two, "b").where(near_size & enough).select("a", "b", "n_a", "n_b"), "near-sizes")
    named_sets = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    sketches = _only(info.select("key", "sketch"), "key", named_sets, "sketch-buckets").join(named_sets.distinct(), "key", "left_semi")
    sketches = written(sketches.groupBy("key").agg(F.any_value("sketch").alias("sketch")), "sketches")
    one = pairs.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a")
    both = one.join(sketches.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b")
    pairs = written(both.mapInArrow(_may_link, "a long, b long, n_a long, n_b long"), "likely")
    allowed = F.floor(F.floor(F.col("n") * SHARE / UNION) * SLACK / SLACK_OF)  # the slack of the smallest set it can link with
    crowds = written(crowded.join(counts.where(F.col("crowds") > allowed).select("key", "n"), "key"), "crowds")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(crowds.select("key")).distinct()
    wanted = wanted.join(owners, "key").where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = written(wanted, "wanted")
    sets = written(_stored_sets(docs, wanted), "features")
    alone = written(_shared_sizes(sets, buckets), "alone")
    one = alone.select(F.col("key").alias("a"), F.col("alone").alias("alone_a"))
    two = alone.select(F.col("key").alias("b"), F.col("alone").alias("alone_b"))
    most_a, most_b = F.col("n_a") - F.coalesce("alone_a", F.lit(0)), F.col("n_b") - F.coalesce("alone_b", F.lit(0))
    most = F.least(most_a, most_b)
    possible = UNION * most >= SHARE * (F.col("n_a") + F.col("n_b") - most)
    pairs = written(pairs.join(one, "a", "left").join(two, "b", "left").where(possible).select("a", "b"), "possible")
    crowds = crowds.join(alone, "key", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0)))
    crowds = crowds.where(UNION * F.col("most") >= SHARE * F.col("n")).drop("alone")
    crowds = crowds.select("signature", "key", "n", "most")
    links = written(_linked(pairs, sets).union(_family_links(crowds, sets)), "linked")
    labels = components(links)

    named = labels.join(owners.select("key", "doc_id"), F.col("node") == F.col("key")).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_key = labels.join(named, "component").select(F.col("node").alias("key"), "component_id")
    found = owners.join(of_key, "key", "left").select(
        "key", "key2", F.coalesce("component_id", "doc_id").alias("component_id"), F.lit(True).alias("known")
    )
    found = written(found, "set-components")
    return info.drop("sketch").join(found, ["key", "key2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component; all columns stay. The least doc_id stays, a null only where
    all are null, and of rows that repeat it the first. Rows are linked by number, so those without doc_id take part."""
    rows = numbered(docs, "near-rows")
    found = similarity_groups(rows.select(F.col("row_no").alias("doc_id"), "text"))
    keeper = F.min_by("row_no", F.struct(F.col("doc_id").isNull(), "doc_id", "row_no"))
    groups = found.select(F.col("doc_id").alias("row_no"), F.col("component_id").alias("group"))
    return one_row_of_each(rows, groups, keeper, "near").select(*docs.columns)
