"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

A legal conversation starts with an optional system turn, then user and assistant take turns, the user first and the
assistant last. Each source turn can keep its role, take another at a cost, or merge into the turn before; an empty
turn can be inserted before it. Dynamic programming over the automaton's states (what the last turn was) finds the
repair of least cost; ties go to the earlier entry in ``MOVES``.

A step's costs are a matrix over states, and matrices combine under (min, +). So a long conversation needs no single
task: turns are range-partitioned by (conversation, turn) and numbered within their conversation, every ``BLOCK``
turns of a conversation are a block with one matrix and one byte a turn, a conversation's blocks are chained, and each
block then walks back through its own turns from the state in which the next one begins. Blocks are cut at fixed turn
numbers, so that results don't depend on partitions. Texts take no part in this: the chosen moves join them by
(conversation, turn number), and pieces are rendered by column expressions, a row at a time. Output is a row per turn;
a conversation's pieces in order of ``seq``, concatenated, are its rendering, which is not put into one row, since a
conversation has no bound.

Nulls: a null role is unknown and takes the cheapest legal role; a null text is empty; null conversation ids form one
conversation, null turns come first. A text of any length is one row's. Repeated rows are turns of their own, ordered by
role and text, ties among them being alike. An empty table gives an empty result. Extra columns, of any name, are
ignored. Unknown roles are relabelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Costs: another role, merging with the turn before, an empty turn; a null or unknown role costs less to set.
RELABEL, MERGE, INSERT, UNKNOWN = 3, 2, 4, 1
#: Steps of the automaton: which turn may follow which state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
#: Rendering of a turn.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def moves() -> list[tuple[int, int, int, int, int | None]]:
    """(state before, state after, cost without roles, role taken, inserted role) of every way to take a turn."""
    found = []
    for state in (START, SYSTEM, USER, ASSISTANT):
        for role in LEGAL[state]:
            found.append((state, role, 0, role, None))
        if state != START:
            found.append((state, state, MERGE, state, None))
        for extra in LEGAL[state]:
            for role in LEGAL[extra]:
                found.append((state, role, INSERT, role, extra))
    return found


MOVES = moves()
KINDS = (None, SYSTEM, USER, ASSISTANT)


def _costs(kind: int | None) -> list[tuple[int, int, int]]:
    """(before, after, cost) of each move for a turn whose given role is ``kind``."""
    return [(a, b, c + (0 if r == kind else UNKNOWN if kind is None else RELABEL)) for a, b, c, r, _ in MOVES]


def step(kind: int | None) -> np.ndarray:
    """Least cost of one turn from each state to each state."""
    out = np.full((4, 4), FAR, np.int64)
    for a, b, c in _costs(kind):
        out[a, b] = min(out[a, b], c)
    return out


STEPS = np.stack([step(k) for k in KINDS])
#: Cost of stopping in a state: after a user an empty assistant turn follows; a system turn alone needs both.
STOP = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.min(a[:, :, None] + b[None], axis=1)


#: Turns of a block; what a task holds of a conversation at once are its blocks' matrices.
BLOCK = 4096
NEUTRAL = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)


def product(matrices: np.ndarray) -> np.ndarray:
    """All matrices (n, 4, 4) chained in order, by halving."""
    while len(matrices) > 1:
        if len(matrices) % 2:
            matrices = np.concatenate([matrices, NEUTRAL[None]])
        matrices = np.minimum(np.min(matrices[0::2, :, :, None] + matrices[1::2, None], axis=2), FAR)
    return matrices[0]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition with their part, their number within their conversation in this part, whether that
    is the part's first conversation, and the code of their role."""
    from pyspark import TaskContext

    part, last, at, first = TaskContext.get().partitionId(), None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        known, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        new = np.append(True, (known[1:] != known[:-1]) | (null[1:] != null[:-1]))
        own = (None if null[0] else int(known[0]),)
        if last is not None and own == last:
            new[0] = False
        elif last is not None:
            first = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        nth = np.where(start < 0, at + np.arange(len(new)), np.arange(len(new)) - start)
        lead = (np.cumsum(new) - new[0] == 0) & first
        codes = [ROLES.get(r, 0) for r in batch.column("role").to_pylist()]
        yield pa.record_batch(
            [ids, pa.array([part] * len(new), pa.int32()), pa.array(nth), pa.array(lead), pa.array(codes, pa.int8()), batch.column("role"), batch.column("text")],
            ["conv_id", "part", "nth", "lead", "code", "role", "text"],
        )
        last, at, first = (None if null[-1] else int(known[-1]),), int(nth[-1]) + 1, bool(lead[-1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, codes, matrix) of rows in order of conversation, block and turn; one block is held at a time."""
    name, held = None, []

    def made(done: list) -> pa.RecordBatch:
        codes = [np.concatenate(c) for _, c in done]
        return pa.record_batch(
            [pa.array([n[0] for n, _ in done], pa.int64()), pa.array([n[1] for n, _ in done], pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([product(STEPS[c]).ravel().tolist() for c in codes], pa.list_(pa.int64()))],
            ["conv_id", "block", "codes", "matrix"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, blocks = batch.column("conv_id"), batch.column("block").to_numpy()
        known, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        codes = batch.column("code").to_numpy()
        heads = np.nonzero(np.append(True, (known[1:] != known[:-1]) | (null[1:] != null[:-1]) | (blocks[1:] != blocks[:-1])))[0].tolist()
        done = []
        for a, b in zip(heads, heads[1:] + [len(known)]):
            own = (None if null[a] else int(known[a]), int(blocks[a]))
            if own != name and name is not None:
                done.append((name, held))
                held = []
            name = own
            held.append(codes[a:b])
        if done:
            yield made(done)
    if name is not None:
        yield made([(name, held)])


def ends(matrices: list[np.ndarray]) -> tuple[list[int], int]:
    """States before, between and after a conversation's blocks on a path of least cost, and that cost."""
    costs = [np.array([0, FAR, FAR, FAR], np.int64)]
    for m in matrices:
        costs.append(np.min(costs[-1][:, None] + m, axis=0))
    last = int(np.argmin(costs[-1] + STOP))
    states = [last]
    for m, before in zip(matrices[::-1], costs[-2::-1]):
        states.append(int(np.argmin(before + m[:, states[-1]])))
    return states[::-1], int((costs[-1] + STOP)[last])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before and after each block, of rows in order of conversation and block. What is held is one
    conversation's matrices, one for each BLOCK turns."""
    held: list[tuple[int | None, int, np.ndarray]] = []

    def solved(rows: list) -> pa.RecordBatch:
        states, cost = ends([m for _, _, m in rows])
        count = len(rows)
        return pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([i == count - 1 for i in range(count)]), pa.array([cost] * count, pa.int64())],
            ["conv", "at", "before", "after", "final", "cost"],
        )

    for batch in batches:
        out = []
        matrices = batch.column("matrix").values.to_numpy().reshape(-1, 4, 4)
        for row in zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist(), matrices):
            if held and held[-1][0] != row[0]:
                out.append(solved(held))
                held = []
            held.append(row)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if held:
        yield solved(held)


def walked(codes: list[int], before: int, after: int) -> list[int]:
    """Moves, by number, of a least-cost path through turns from one state to another."""
    best = np.full((len(codes) + 1, 4), FAR, np.int64)
    best[0, before] = 0
    back = np.zeros((len(codes), 4), np.int64)
    tables = [_costs(k) for k in KINDS]
    for t, code in enumerate(codes):
        for i, (a, b, c) in enumerate(tables[code]):
            if best[t, a] + c < best[t + 1, b]:
                best[t + 1, b] = best[t, a] + c
                back[t, b] = i
    path, state = [], after
    for t in range(len(codes) - 1, -1, -1):
        path.append(int(back[t, state]))
        state = MOVES[path[-1]][0]
    return path[::-1]


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, at, move, last, cost) of every turn of each block: its move by number, and whether it is the
    conversation's last."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            rows = batch.slice(first, 4096).to_pylist()
            paths = [walked(list(r["codes"]), r["before"], r["after"]) for r in rows]
            sizes = [len(p) for p in paths]
            last = np.zeros(sum(sizes), bool)
            last[np.cumsum(sizes)[[r["final"] for r in rows]] - 1] = True
            at = [r["block"] * BLOCK + i for r, n in zip(rows, sizes) for i in range(n)]
            conv = [r["conv_id"] for r, n in zip(rows, sizes) for _ in range(n)]
            cost = np.repeat(np.array([r["cost"] for r in rows], np.int64), sizes)
            yield pa.record_batch(
                [pa.array(conv, pa.int64()), pa.array(at, pa.int64()), pa.array([m for p in paths for m in p], pa.int32()), pa.array(last), pa.array(cost)],
                ["conv", "at", "move", "last", "cost"],
            )


def _turn(role: int) -> str:
    return OPEN.format(role=NAMES[role])


def _before(move: int) -> str:
    """What a move writes before its turn's text."""
    state, _, _, role, extra = MOVES[move]
    if role == state:
        return "\n"
    return CLOSE * (state != START) + (_turn(extra) + CLOSE if extra is not None else "") + _turn(role)


def _after(role: int) -> str:
    """What ends a conversation whose last turn has this role."""
    return CLOSE + "".join(_turn(r) + CLOSE for r in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(role, ()))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, role, action, piece, cost): a row per source turn. ``seq`` counts a conversation's turns from 0;
    ``cost`` is the conversation's."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = conversations.select("conv_id", "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "conv_id long, part int, nth long, lead boolean, code byte, role string, text string"
    placed = written(rows.drop("turn").mapInArrow(_placed, schema), "turns")
    # only a part's first conversation can have begun in parts before: at most one row for each part
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("lead").alias("lead"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(counts.withColumn("offset", before).where("lead AND offset > 0").select("part", "offset"), "part-offsets")
    seq = F.col("nth") + F.when(F.col("lead"), F.coalesce("offset", F.lit(0))).otherwise(0)
    turns = placed.join(offsets, "part", "left").select("conv_id", seq.alias("seq"), "code", "role", "text")

    coded = turns.select("conv_id", F.expr(f"seq DIV {BLOCK}").alias("block"), "seq", "code")
    coded = coded.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq")
    blocks = written(coded.mapInArrow(_blocks, "conv_id long, block long, codes binary, matrix array<long>"), "turn-blocks")
    chained_blocks = blocks.select("conv_id", "block", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    states = written(chained_blocks.mapInArrow(_ends, "conv long, at long, before int, after int, final boolean, cost long"), "block-ends")
    marked = blocks.drop("matrix").join(states, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("at")))
    moves = marked.select("conv_id", "block", "codes", "before", "after", "final", "cost").mapInArrow(_moves, "conv long, at long, move int, last boolean, cost long")

    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("move") + 1)
    name = pick([NAMES[m[3]] for m in MOVES])
    kind = pick(["merge" if m[3] == m[0] else "insert" if m[4] is not None else "" for m in MOVES])
    action = F.when(kind != "", kind).otherwise(F.when(F.col("role").eqNullSafe(name), "keep").otherwise("relabel"))
    end = F.when(F.col("last"), pick([_after(m[3]) for m in MOVES])).otherwise("")
    closes = F.when(F.col("last") & (name != NAMES[ASSISTANT]), "+close").otherwise("")
    return turns.join(moves, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("seq") == F.col("at"))).select(
        "conv_id",
        "seq",
        name.alias("role"),
        F.concat(action, closes).alias("action"),
        F.concat(pick([_before(i) for i in range(len(MOVES))]), F.coalesce("text", F.lit("")), end).alias("piece"),
        "cost",
    )


def conversations_summary(pieces: DataFrame) -> DataFrame:
    """(conv_id, cost, n_turns, n_merge, n_relabel, n_insert) per conversation, by pre-aggregated counts."""
    has = lambda word: F.count_if(F.col("action").startswith(word))
    return pieces.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.count(F.lit(1)).alias("n_turns"), has("merge").alias("n_merge"), has("relabel").alias("n_relabel"), has("insert").alias("n_insert"))
