"""Spelling variants: words that differ by one code point, found by a frequency-vector trie.

Words. Runs of letters are counted by DataFrame functions: of each run at least as long as the least word, the one
spoiled code point is deleted where the checksum says so, and counts are pre-aggregated.

Trie. A word is arranged by its length and then by its counts of successive groups of letters (``GROUPS``, each letter
in one). One inserted code point changes the vector by a surplus of one in one group; a replaced one by a surplus of one
and a deficit of one, or not at all within a group. So the search descends with a budget of one surplus and one
deficit. Every pair is found once: from the shorter word, which spends a surplus, or from the word whose surplus comes
in an earlier group than its deficit; words with equal vectors meet from the lesser one. Leaves are verified by comparing
prefixes and suffixes of the words themselves.

Plan. Words are range-partitioned in order of their vectors into shards of about ``SHARD`` words, so that a shard is a
stretch of the trie's leaves. The shards' first vectors (at most ``MOST_SHARDS`` of 68 bytes) are sent to all tasks; a
word descends through them first, and goes only to those shards that its budget reaches. A shard's task builds its part
of the trie and answers the words that come, in blocks: the frontier of a whole block descends one group at a time in
numpy. Nothing is compared outside a leaf, and the largest thing a task holds is a shard. Equal vectors may lie across
shards.

Forms. Near pairs are aggregated for each word; the form is its near word of largest count (ties: least), if that is at
least ``RATIO`` times its own. Counts grow along forms, so chains end; roots are found by doubling.

Nulls: a null text has no runs; a null doc_id counts as an empty string in the checksum. Empty texts have no words,
words of any length are counted and compared. Repeated rows count as often as they come. Equal counts tie as
said. An empty table, or one without words, gives an empty result. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, text_bytes, written

LETTERS = r"A-Za-zÀ-ÿ"
SPOIL, LEAST, OCCURRENCES, RATIO = 31, 7, 2, 10
#: Letters whose counts are one step of the trie, the most telling first; all others are the last group.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "u", "dm", "cg", "hk", "bpf", "vwzjxqy")
SHARD, MOST_SHARDS = 1 << 15, 1 << 16
#: Words that descend together, and pairs that are verified together.
WORDS, PAIRS = 8192, 1 << 18
#: Words up to this length are compared as rows of one matrix.
SHORT = 32
#: Descent: same length so far even; surplus spent; both spent; one letter more, to come; and come.
EVEN, SURPLUS, BOTH, LONGER, GROWN = range(5)


def _table() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)
    for i, letters in enumerate(GROUPS):
        out[[ord(c) for c in letters]] = i
    return out


GROUP_OF = _table()
DEPTH = len(GROUPS) + 2


def word_counts(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``least`` code points after spoiling, that occur often enough."""
    # a run only shrinks when it is spoiled, so shorter ones can't become words
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), 0)).alias("run"))
    capitals = "".join(map(chr, range(65, 91)))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capitals, capitals.lower())).otherwise(F.col("run"))
    runs = runs.select("doc", lowered.alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    spoiled = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % SPOIL == 0, spoiled).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= occurrences)


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as code points up to 255, all in one array, with offsets."""
    data, offsets = text_bytes(column)
    lead = data >= 0xC0  # two bytes in UTF-8: 110000xx 10xxxxxx
    tail = np.append(False, lead[:-1]) if len(data) else lead
    codes = data.copy()
    codes[tail] = (data[tail] & 0x3F) | (data[np.nonzero(tail)[0] - 1] << 6)
    ends = np.append(0, np.cumsum(~lead))
    return codes[~lead], ends[offsets]


def vectors(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each word: its length, then its counts of each group."""
    count = len(offsets) - 1
    row = np.repeat(np.arange(count), np.diff(offsets))
    groups = np.bincount(row * (DEPTH - 1) + GROUP_OF[codes], minlength=count * (DEPTH - 1)).reshape(count, DEPTH - 1)
    return np.concatenate([np.diff(offsets)[:, None], groups], axis=1).astype(np.int64)


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vector, word, n): vectors as big-endian bytes, whose order is that of the trie's leaves."""
    for batch in batches:
        if batch.num_rows:
            found = vectors(*latin(batch.column("word"))).astype(">u4")
            data = pa.py_buffer(found.tobytes())
            fixed = pa.Array.from_buffers(pa.binary(DEPTH * 4), batch.num_rows, [None, data])
            yield pa.record_batch([fixed.cast(pa.binary()), batch.column("word"), batch.column("n")], ["vector", "word", "n"])


def unvector(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[0].view(">u4").reshape(-1, DEPTH).astype(np.int64)


class Trie:
    """Sorted vectors as a trie: at each level the nodes' keys, (parent's number, count), in order."""

    def __init__(self, sorted_vectors: np.ndarray):
        self.width = int(sorted_vectors.max(initial=0)) + 3
        self.keys, node = [], np.zeros(len(sorted_vectors), np.int64)
        for level in range(DEPTH):
            key = node * self.width + sorted_vectors[:, level] + 1
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            self.keys.append(key[new])
            node = np.cumsum(new) - 1
        self.starts = np.append(np.nonzero(new)[0], len(sorted_vectors)) if len(sorted_vectors) else np.zeros(1, np.int64)

    def children(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node: whether it has a child of this count, and the child's number."""
        keys = self.keys[level]
        key = node * self.width + np.clip(count, -1, self.width - 2) + 1
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, at

    def search(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``asked``, leaf, whether it is the vector itself) of all leaves that a descent from each asked vector
        reaches."""
        who, state, node = np.arange(len(asked)), np.full(len(asked), EVEN), np.zeros(len(asked), np.int64)
        if not len(self.keys[0]):
            return who[:0], node[:0], state[:0] == EVEN
        for level in range(DEPTH):
            reached = []
            for before, change, after in MOVES[level > 0]:
                some = np.nonzero(state == before)[0]
                has, child = self.children(level, node[some], asked[who[some], level] + change)
                some = some[has]
                reached.append((who[some], np.full(len(some), after), child[has]))
            who, state, node = (np.concatenate(x) for x in zip(*reached))
        ended = (state != SURPLUS) & (state != LONGER)
        return who[ended], node[ended], state[ended] == EVEN


#: (state before, change of the count, state after) on the first level, the length, and on those of groups.
MOVES = (
    ((EVEN, 0, EVEN), (EVEN, 1, LONGER)),
    ((EVEN, 0, EVEN), (EVEN, 1, SURPLUS), (SURPLUS, 0, SURPLUS), (SURPLUS, -1, BOTH), (BOTH, 0, BOTH), (LONGER, 0, LONGER), (LONGER, 1, GROWN), (GROWN, 0, GROWN)),
)


def shards_reached(firsts: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asked``, shard number) of the shards that a descent can reach. ``firsts``: the first vectors of all
    shards but the first one. A descent ends where one shard is left; a vector equal to a first one may lie before it, too."""
    if not len(firsts):
        return np.arange(len(asked)), np.zeros(len(asked), np.int64)
    width = int(max(firsts.max(), asked.max(initial=0))) + 3
    who, state = np.arange(len(asked)), np.full(len(asked), EVEN)
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(firsts))
    node, done = np.zeros(len(firsts), np.int64), [(who[:0], low[:0])]
    for level in range(DEPTH):
        key = node * width + firsts[:, level] + 1
        reached = []
        for before, change, after in MOVES[level > 0]:
            some = np.nonzero(state == before)[0]
            count = np.clip(asked[who[some], level] + change, -1, width - 2) + 1
            here = node[np.minimum(low[some], len(firsts) - 1)] * width + count  # first vectors low..high-1 share the prefix
            a, b = np.searchsorted(key, here), np.searchsorted(key, here, side="right")
            a, b = np.clip(a, low[some], high[some]), np.clip(b, low[some], high[some])
            reached.append((who[some], np.full(len(some), after), a, b))
        who, state, low, high = (np.concatenate(x) for x in zip(*reached))
        one = low == high
        done.append((who[one], low[one]))
        who, state, low, high = who[~one], state[~one], low[~one], high[~one]
        node = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    sizes = high - low + 1  # what is left equals some first vectors
    done.append((np.repeat(who, sizes), np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)))
    who, shard = (np.concatenate(x) for x in zip(*done))
    both = np.unique(who * (len(firsts) + 1) + shard)
    return both // (len(firsts) + 1), both % (len(firsts) + 1)


class Words:
    """Words of at most 255 a code point: short ones as rows of a matrix, filled with 0 behind."""

    def __init__(self, column: pa.Array):
        self.codes, self.offsets = latin(column)
        self.sizes = np.diff(self.offsets)
        at = np.arange(SHORT)
        self.rows = np.where(at < self.sizes[:, None], self.codes[np.minimum(self.offsets[:-1, None] + at, max(0, len(self.codes) - 1))] if len(self.codes) else 0, 0).astype(np.uint8)

    def word(self, i: int) -> bytes:
        return self.codes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def differ_by_one(a: bytes, b: bytes) -> bool:
    """Whether b is a with one code point inserted or replaced."""
    if len(b) - len(a) not in (0, 1):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    unlike = np.nonzero(x != y[: len(x)])[0]
    if len(a) == len(b):
        return len(unlike) == 1
    first = unlike[0] if len(unlike) else len(x)
    return a[first:] == b[first + 1 :]


def near(one: Words, i: np.ndarray, other: Words, j: np.ndarray) -> np.ndarray:
    """For pairs of rows whether other's word is one's with one code point inserted or replaced."""
    out = np.zeros(len(i), bool)
    m, n = one.sizes[i], other.sizes[j]
    small = np.maximum(m, n) <= SHORT
    for same in (True, False):
        some = np.nonzero(small & (n - m == (0 if same else 1)))[0]
        x, y = one.rows[i[some]], other.rows[j[some]]
        unlike = x != y
        if same:
            out[some] = unlike.sum(axis=1) == 1
        else:
            first = unlike.argmax(axis=1)  # the longer word has one more, so some place is unlike
            moved = np.concatenate([y[:, 1:], np.zeros((len(y), 1), np.uint8)], axis=1)
            out[some] = ((x == moved) | (np.arange(SHORT) < first[:, None])).all(axis=1)
    for p in np.nonzero(~small)[0].tolist():
        out[p] = differ_by_one(one.word(i[p]), other.word(j[p]))
    return out


def _routed(firsts: bytes, numbers: list[int]):
    """A function that deals words to the shards that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.frombuffer(firsts, ">u4").reshape(-1, DEPTH).astype(np.int64)[1:]
        number = np.array(numbers, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, WORDS):
                part = batch.slice(start, WORDS)
                who, shard = shards_reached(first, unvector(part.column("vector")))
                part = part.select(["vector", "word", "n"]).take(pa.array(who))
                yield pa.record_batch([pa.array(number[shard]), *part.columns], ["shard", "vector", "word", "n"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (word, n, other, other_n) of rows sorted by shard, a shard's own words, by vector, before those that ask."""
    release()
    shard, held, trie, own, names, counts = None, [], None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        heads = np.nonzero(np.append(True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])))[0].tolist()
        for a, b in zip(heads, [*heads[1:], len(shards)]):
            part = batch.slice(a, b - a)
            if not asks[a]:
                if shards[a] != shard:
                    shard, held, trie = shards[a], [], None
                held.append(part.select(["vector", "word", "n"]))
                continue
            if shards[a] != shard:
                continue  # no word was dealt to this shard
            if trie is None:
                table = pa.Table.from_batches(held).combine_chunks()
                trie, own, held = Trie(unvector(table.column("vector"))), Words(table.column("word")), []
                names, counts = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            for start in range(0, part.num_rows, WORDS):
                some = part.slice(start, WORDS)
                who, leaf, same = trie.search(unvector(some.column("vector")))
                asking = Words(some.column("word"))
                sizes = np.diff(trie.starts)[leaf]
                cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), PAIRS), side="right").tolist()
                for c, d in zip(cuts, [*cuts[1:], len(leaf)]):
                    n = sizes[c:d]
                    i = np.repeat(who[c:d], n)
                    j = np.repeat(trie.starts[leaf[c:d]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    good = near(asking, i, own, j)
                    for p in np.nonzero(good & np.repeat(same[c:d], n))[0].tolist():
                        good[p] = asking.word(i[p]) < own.word(j[p])
                    i, j = pa.array(i[good]), pa.array(j[good])
                    yield pa.record_batch([some.column("word").take(i), some.column("n").take(i), names.take(j), counts.take(j)], ["word", "n", "other", "other_n"])


def near_pairs(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, other, other_n) of all pairs of near words of (word, n), each once."""
    count = max(1, min(MOST_SHARDS, -(-words.count() // shard)))
    arranged = words.mapInArrow(_arranged, "vector binary, word string, n long")
    shards = written(arranged.repartitionByRange(count, "vector", "word").withColumn("shard", F.spark_partition_id().cast("long")), "spelling-shards")
    firsts = shards.groupBy("shard").agg(F.min("vector").alias("first")).orderBy("shard").collect()  # one row a shard
    route = _routed(b"".join(bytes(r["first"]) for r in firsts), [r.shard for r in firsts])
    asking = shards.mapInArrow(route, "shard long, vector binary, word string, n long").withColumn("asks", F.lit(True))
    met = shards.withColumn("asks", F.lit(False)).unionByName(asking).repartition(count, "shard").sortWithinPartitions("shard", "asks", "vector")
    return met.mapInArrow(_pairs, "word string, n long, other string, other_n long")


def spelling_groups(docs: DataFrame, least: int = LEAST, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the texts."""
    words = written(word_counts(docs, least), "spelling-words")
    found = near_pairs(words, shard)
    both = F.explode(F.array(*(F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n" if b == "other" else "n")).alias("less"), F.col(b).alias("word")).alias("near")) for a, b in (("word", "other"), ("other", "word")))))
    sides = found.select(both.alias("side")).select("side.*", F.lit(None).cast("long").alias("n"))
    none = F.lit(None).cast("struct<less:long,word:string>").alias("near")
    all_rows = words.select("word", none, "n").unionByName(sides)
    best = all_rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    is_form = -F.col("near.less") >= F.col("n") * ratio
    formed = written(best.select("word", "n", "n_near", F.when(is_form, F.col("near.word")).alias("form"), F.when(is_form, -F.col("near.less")).alias("form_n")), "spelling-forms")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    return formed.where("form IS NULL").withColumn("root", F.col("word")).unionByName(formed.where("form IS NOT NULL").join(roots(links), "word"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of links (word, root), by doubling."""
    links = written(links, "spelling-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links
