"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per task.

Pieces of a block are dictionary-encoded; those that the worker has not met yet become rows (piece, position, token)
that join the merge table. Each round of the recursion contracts the leftmost pair of least rank of every piece that
has one, until none has. Ordered aggregation then gives a piece's ids, and from the ids its bytes again.

Pieces of more than ``LONG`` bytes contract all occurrences of their least pair in one round, leftmost first and
without overlap. That gives the same merges if a run's ranks never decrease, which holds for a vocabulary in which
every token of several bytes, merged with lesser ranks only, comes down to exactly two parts. For let a merge of rank r
be the first after which a lesser rank becomes possible, by a pair that makes token t. The bytes of t were symbols of
their own until then, so merges within them went as they go for t alone, in order of rank; those with ranks below t's
are exhausted, as t's rank is below r. So by the condition two parts were left, whose pair has t's rank and would have
been merged before r. ``ordered`` checks the condition for the whole vocabulary when it is loaded; without it, pieces
of every length take the leftmost pair. A query makes as many rounds as ``ROWS`` rows allow and the next one goes on
from there, so that memory has a bound and nothing spills to a disk.

Nulls count as empty texts, which have no ids; a text of any length is split into pieces by its block; ties between
equal pairs go to the left; repeated rows repeat; an empty table gives an empty result. Extra columns, of any name, are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.common import blocks, worker_state
from millrace.llm.pretokens import pieces

#: Pieces that a worker keeps between batches and tasks; pieces and bytes per recursive query; bytes of a long piece;
#: rows that the rounds of one query make at most.
KEPT_PIECES, PER_QUERY, LONG, ROWS = 120_000, 10_000, 64, 1_000_000

SHORT_ROUNDS = """
WITH RECURSIVE turn(piece, pos, token, done, nth) AS (
    SELECT piece, pos, token, false, 0 FROM symbols
    UNION ALL
    SELECT piece, pos, CASE WHEN pos = best & 4294967295 THEN (best >> 32)::INT ELSE token END, best IS NULL, nth + 1
    FROM (
        WITH ranked AS MATERIALIZED (
            SELECT t.piece, t.pos, t.token, t.nth, t.before, (m.merged::BIGINT << 32) | t.pos AS pair
            FROM (
                SELECT *, lead(token) OVER w AS after, lag(pos) OVER w AS before
                FROM turn WHERE NOT done AND nth < $rounds WINDOW w AS (PARTITION BY piece ORDER BY pos)
            ) t LEFT JOIN merges m ON m.pair = (t.token::BIGINT << 20) | t.after
        )
        SELECT r.*, best FROM ranked r JOIN (SELECT piece, min(pair) AS best FROM ranked GROUP BY piece) USING (piece)
    ) WHERE best IS NULL OR before IS DISTINCT FROM best & 4294967295
)
"""
LONG_ROUNDS = """
WITH RECURSIVE turn(piece, pos, token, done, nth) AS (
    SELECT piece, pos, token, false, 0 FROM symbols
    UNION ALL
    SELECT piece, pos, CASE WHEN taken THEN best ELSE token END, best IS NULL, nth + 1
    FROM (
        SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY pos), false) AS gone
        FROM (
            SELECT *, hit AND (row_number() OVER (PARTITION BY piece, hit, island ORDER BY pos)) % 2 = 1 AS taken
            FROM (
                SELECT *, merged = best AND best IS NOT NULL AS hit,
                    seat - row_number() OVER (PARTITION BY piece, merged = best AND best IS NOT NULL ORDER BY pos) AS island
                FROM (
                    SELECT t.*, m.merged, min(m.merged) OVER (PARTITION BY t.piece) AS best
                    FROM (
                        SELECT *, lead(token) OVER w AS after, row_number() OVER w AS seat
                        FROM turn WHERE NOT done AND nth < $rounds WINDOW w AS (PARTITION BY piece ORDER BY pos)
                    ) t LEFT JOIN merges m ON m.pair = (t.token::BIGINT << 20) | t.after
                )
            )
        )
    ) WHERE best IS NULL OR NOT gone
)
"""
STATE = "SELECT piece, pos, token, done FROM turn WHERE done OR nth = $rounds"
RESULT = """
SELECT f.piece, string_agg(f.token::VARCHAR, ',' ORDER BY f.pos) AS ids, string_agg(v.hex, '' ORDER BY f.pos) AS bytes
FROM finished f JOIN vocabulary v ON v.token = f.token GROUP BY f.piece ORDER BY f.piece
"""


def ordered(ranks: dict[bytes, int]) -> bool:
    """Whether each token of several bytes comes down to two parts by the merges of lesser ranks."""
    for token, limit in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)]
            rank, i = min(found)
            if rank >= limit:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class Merges:
    """A worker's database with the vocabulary and the merge table, and the pieces that it has encoded."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [
            (ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.bytes_of = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        pair, merged = zip(*pairs)
        found = pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int32())})
        words = pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
        self.db.register("found", found)
        self.db.register("words", words)
        self.db.execute("CREATE TABLE merges AS FROM found; CREATE TABLE vocabulary AS FROM words")
        self.known: dict[str, str] = {}
        self.batches = ordered(ranks)

    def query(self, rounds: str, words: list[bytes]) -> list[tuple[str, bytes]]:
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        piece = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols = pa.table({"piece": piece, "pos": pos, "token": self.bytes_of[data]})
        finished = []
        while symbols.num_rows:
            self.db.register("symbols", symbols)
            state = self.db.sql(rounds + STATE, params={"rounds": max(2, ROWS // symbols.num_rows)}).to_arrow_table()
            self.db.unregister("symbols")
            done = state["done"]
            finished.append(state.filter(done))
            symbols = state.filter(pc.invert(done)).select(["piece", "pos", "token"])
        self.db.register("finished", pa.concat_tables(finished))
        out = self.db.sql(RESULT).to_arrow_table()
        self.db.unregister("finished")
        return list(zip(out["ids"].to_pylist(), map(bytes.fromhex, out["bytes"].to_pylist())))

    def encode(self, words: list[str]) -> list[tuple[str, bytes]]:
        """(ids joined by commas, the bytes decoded from the ids) of each distinct piece. A piece is kept only if its
        ids decoded to its own bytes, so that those need not be kept."""
        result = [(self.known[w], w.encode()) if w in self.known else None for w in words]
        raw = {i: words[i].encode("utf-8", "surrogatepass") for i, found in enumerate(result) if found is None}
        for rounds, new in (
            (SHORT_ROUNDS, [i for i, w in raw.items() if len(w) <= LONG or not self.batches]),
            (LONG_ROUNDS, [i for i, w in raw.items() if len(w) > LONG and self.batches]),
        ):
            first = 0
            while first < len(new):
                last, size = first, 0
                while last < len(new) and last - first < PER_QUERY and (last == first or size + len(raw[new[last]]) <= PER_QUERY * 12):
                    size += len(raw[new[last]])
                    last += 1
                some = new[first:last]
                for i, found in zip(some, self.query(rounds, [raw[i] for i in some])):
                    result[i] = found
                    if len(self.known) < KEPT_PIECES and len(raw[i]) <= 40 and found[1] == raw[i]:
                        self.known[words[i]] = found[0]
                first = last
        return result


def merges(path: str) -> Merges:
    state = worker_state("bpe")
    if path not in state:
        state[path] = Merges(path)
    return state[path]


def encode_documents(docs: DataFrame, ranks: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, and ``ids array<int>`` if asked for.

    ``ids_sha256`` is of the decimal ids joined by commas; ``decoded_sha256`` of the bytes that the ids decode to.
    """
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, counts = pieces(block.column("text"))
            table = merges(ranks).encode(words.dictionary.to_pylist())
            joined, decoded = ([x[k] for x in table] for k in range(2))
            n = np.fromiter((x.count(",") + 1 for x in joined), np.int64, len(joined))
            codes = words.indices.to_numpy()
            edges = np.append(0, np.cumsum(counts))
            totals = np.append(0, np.cumsum(n[codes]))[edges]
            first, second, lists = [], [], []
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                own = codes[a:b].tolist()
                text = ",".join([joined[c] for c in own])
                first.append(hashlib.sha256(text.encode()).hexdigest())
                second.append(hashlib.sha256(b"".join([decoded[c] for c in own])).hexdigest())
                if ids:
                    lists.append(np.array(text.split(",") if text else [], np.int32))
            yield pa.record_batch(
                [block.column("doc_id"), pa.array(np.diff(totals)), pa.array(first, pa.string()), pa.array(second, pa.string())]
                + [pa.array(lists, pa.list_(pa.int32()))] * ids,
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids,
            )

    return docs.select("doc_id", "text").mapInArrow(encode, columns)
