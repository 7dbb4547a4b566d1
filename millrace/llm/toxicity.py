"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training, from labelled documents only: counts per feature (a word, its first or last letters) in toxic and clean
documents give the strong features; words with one of them in toxic documents are the labelled tokens. A two-state
chain (toxic, other) learns weights for the strong features and for transitions on windows of these tokens, by
gradient steps on the exact log-likelihood. A logistic curve over the document's expected number of toxic tokens and
its greatest marginal, fitted to the same documents, gives scores from 0 to 1.

``SAMPLE`` bounds the labelled documents of each class that training reads, chosen by a hash of doc_id. The chain learns
from the windows around all their tokens with a strong feature, and one in each text's middle; a document's windows
weigh ``PER_DOCUMENT`` in all, however many they are, so that long texts don't outweigh short ones. Windows are the rows that
the chain is fitted to: at most ``WINDOWS`` of them, by a hash of their words. ``RIDGE`` and ``PER_DOCUMENT`` were chosen on a
fold within the training rows (``inner_fold``), which held-out rows are no part of. Everything else covers all rows. Scoring
runs within one map over whole texts: forward and backward messages of all documents of a block are one scan over 2 x 2
matrices, in which a document's first token resets the chain.

Nulls and empty texts have no tokens and get the curve's value for none. Repeated label rows count once, toxic if any
is. Without labelled rows of both classes all scores are the share of toxic labels (0 without labels). A text of
any length is scored as a whole, in a block of its own where it is longer than a block. An empty table gives an empty
result. Extra columns are kept by ``scored`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import blocks, worker_state, written
from millrace.llm.pretokens import pieces

#: Labelled documents of each class that training reads at most; strong features that the model keeps at most.
SAMPLE, FEATURES = 4000, 20_000
#: A strong feature: least log-likelihood ratio, and how much more often toxic documents have it.
LEAST_RATIO, LEAST_LIFT = 24.0, 10.0
WINDOW, ROUNDS, THRESHOLD = 6, 80, 0.3
#: Weight of all windows of a training document together, and the most windows that the chain is fitted to.
PER_DOCUMENT, WINDOWS = 3.0, 60_000
#: Pull of the weights towards 0.
RIDGE = 0.5


@dataclass
class Model:
    """Weights by feature, bias of the toxic state, transition scores [from][to] (other, toxic), and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: tuple = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple = (0.0, 0.0, 0.0)
    constant: float | None = None
    _name: str = ""

    def name(self) -> str:
        """A digest of what emissions depend on."""
        if not self._name:
            self._name = hashlib.md5(repr((self.bias, sorted(self.weights.items()))).encode()).hexdigest()
        return self._name


def features(piece: str) -> list[str]:
    """Features of a token; none for what isn't a word."""
    word = piece.strip().lower()
    if len(word) < 3 or not word[0].isalpha():
        return []
    return ["=" + word] + ["<" + word[:n] for n in (3, 4, 5) if len(word) > n] + [">" + word[-4:]] * (len(word) > 4)


def sample(docs: DataFrame, labels: DataFrame, held_out=None, size: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``size`` labelled documents of each class that are not held out."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    # 2 * size rows of two numbers at most: bounded by a parameter, so broadcast
    return docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id").select("toxic", "text")


def _feature_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {0: Counter(), 1: Counter()}
        for block in blocks(batches):
            words, counts = pieces(block.column("text"))
            table = [features(w) for w in words.dictionary.to_pylist()]
            codes, edges = words.indices.to_numpy(), np.append(0, np.cumsum(counts)).tolist()
            for toxic, a, b in zip(block.column("toxic").to_pylist(), edges, edges[1:]):
                found[toxic].update({f for c in set(codes[a:b].tolist()) for f in table[c]})
        names = list(found[0] | found[1])
        for a in range(0, len(names), 50_000):
            some = names[a : a + 50_000]
            yield pa.record_batch([pa.array(some, pa.string())] + [pa.array([found[y][x] for x in some], pa.int64()) for y in (0, 1)], ["feature", "clean", "toxic"])

    counted = docs.mapInArrow(count, "feature string, clean long, toxic long")
    return counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _strong(counts: DataFrame, clean: int, toxic: int, most: int = FEATURES) -> list[str]:
    """Features that toxic documents have far more often, the most significant first."""
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / (clean + toxic)
    ratio = 2 * (part(a, share * toxic) + part(b, share * clean))
    lift = (a / toxic) / ((b + 0.5) / (clean + 1))
    rows = counts.where((ratio >= LEAST_RATIO) & (lift >= LEAST_LIFT)).orderBy(ratio.desc(), "feature").limit(most)
    return [r["feature"] for r in rows.select("feature").collect()]


def _windows(docs: DataFrame, strong: set[str]) -> DataFrame:
    """(words, toxic, weight): windows of tokens with their labels, around every token with a strong feature and in the
    text's middle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, counts = pieces(block.column("text"))
            table = words.dictionary.to_pylist()
            hit = np.array([any(f in strong for f in features(w)) for w in table], bool)
            codes, edges = words.indices.to_numpy(), np.append(0, np.cumsum(counts)).tolist()
            out, tags, weights = [], [], []
            for toxic, a, b in zip(block.column("toxic").to_pylist(), edges, edges[1:]):
                if b == a:
                    continue
                marked = hit[codes[a:b]]
                hits = np.nonzero(marked)[0].tolist()
                marked = marked & bool(toxic)  # in clean documents the same words are counterexamples
                for p, weight in [*((p, min(1.0, PER_DOCUMENT / len(hits))) for p in hits), ((b - a) // 2, 1.0)]:
                    low, high = max(0, p - WINDOW), min(b - a, p + WINDOW + 1)
                    out.append([table[c] for c in codes[a + low : a + high]])
                    tags.append(marked[low:high].astype(np.int8).tolist())
                    weights.append(weight)
            yield pa.record_batch([pa.array(out, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int8())), pa.array(weights, pa.float64())], ["words", "toxic", "weight"])

    return docs.mapInArrow(cut, "words array<string>, toxic array<byte>, weight double")


def fit_chain(sequences: list[tuple[list[str], list[int], float]], strong: list[str]) -> Model:
    """Maximises the weighted conditional log-likelihood of the labels of (words, labels, weight) by Adagrad on all
    windows at once."""
    model = Model()
    if not sequences:
        return model
    number = {f: i for i, f in enumerate(strong)}
    length = max(len(w) for w, _, _ in sequences)
    weights = np.array([weight for _, _, weight in sequences])
    n = len(sequences)
    real, gold = np.zeros((length, n), bool), np.zeros((length, n))
    rows, cols, ids = [], [], []
    for j, (words, tags, _) in enumerate(sequences):
        real[: len(words), j] = True
        gold[: len(words), j] = tags
        for t, word in enumerate(words):
            for f in features(word):
                if f in number:
                    rows.append(t)
                    cols.append(j)
                    ids.append(number[f])
    rows, cols, ids = np.array(rows, int), np.array(cols, int), np.array(ids, int)
    w, bias, moves = np.zeros(len(strong)), -3.0, np.zeros((2, 2))
    gw, gb, gm = np.full(len(strong), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    both = real[1:]
    pair = [[(((gold[:-1] == i) & (gold[1:] == j) & both) * weights).sum() for j in (0, 1)] for i in (0, 1)]
    for _ in range(ROUNDS):
        u = np.full((length, n), bias)
        np.add.at(u, (rows, cols), w[ids])
        e = np.stack([np.zeros_like(u), u], axis=-1)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, length):
            step = np.logaddexp(alpha[t - 1][:, :1] + moves[0], alpha[t - 1][:, 1:] + moves[1]) + e[t]
            alpha[t] = np.where(real[t][:, None], step, alpha[t - 1])
        for t in range(length - 2, -1, -1):
            inner = e[t + 1] + beta[t + 1]
            step = np.logaddexp(moves[:, 0] + inner[:, :1], moves[:, 1] + inner[:, 1:])
            beta[t] = np.where(real[t + 1][:, None], step, 0.0)
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - total) * real
        d = (gold - p) * real * weights
        dw = np.bincount(ids, d[rows, cols], len(strong)) - RIDGE * w
        db = d.sum() - 0.02 * bias
        dm = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                q = np.exp(alpha[:-1, :, i] + moves[i, j] + e[1:, :, j] + beta[1:, :, j] - total) * both * weights
                dm[i, j] = pair[i][j] - q.sum() - 0.02 * moves[i, j]
        gw, gb, gm = gw + dw**2, gb + db**2, gm + dm**2
        w, bias, moves = w + 0.7 * dw / np.sqrt(gw), bias + 0.3 * db / math.sqrt(gb), moves + 0.3 * dm / np.sqrt(gm)
    model.weights = {f: float(x) for f, x in zip(strong, w) if abs(x) > 1e-4}
    model.bias, model.moves = float(bias), tuple(map(tuple, moves.tolist()))
    return model


def _scan(matrices: np.ndarray) -> np.ndarray:
    """Prefix products m[t] @ ... @ m[0] of 2 x 2 matrices (n, 2, 2), each scaled to sum 1, in blocks."""
    n, side = len(matrices), 64
    if n <= side:
        out = matrices.copy()
        for t in range(1, n):
            out[t] = matrices[t] @ out[t - 1]
            out[t] /= out[t].sum()
        return out
    count = -(-n // side)
    m = np.empty((count * side, 2, 2))
    m[:n] = matrices
    m[n:] = np.eye(2) / 2
    m = np.ascontiguousarray(m.reshape(count, side, 4).transpose(1, 2, 0))
    for t in range(1, side):
        a, b, c, d = m[t].copy()
        p, q, r, s = m[t - 1]
        m[t] = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        m[t] /= m[t].sum(axis=0)
    before = _scan(np.ascontiguousarray(m[-1].T).reshape(count, 2, 2))[:-1].reshape(-1, 4).T
    a, b, c, d = m[:, :, 1:].transpose(1, 0, 2).copy()
    p, q, r, s = before
    x = np.stack([a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s], axis=1)
    m[:, :, 1:] = x / x.sum(axis=1, keepdims=True)
    return m.transpose(2, 0, 1).reshape(-1, 2, 2)[:n]


def marginals(scores: np.ndarray, starts: np.ndarray, moves) -> np.ndarray:
    """Probability of the toxic state of each token of concatenated chains; ``starts`` marks first tokens."""
    n = len(scores)
    if not n:
        return np.zeros(0)
    move = np.exp(np.array(moves) - np.max(moves))
    e = np.stack([np.ones(n), np.exp(np.clip(scores, -40, 40))], axis=1)
    forward = e[:, :, None] * move.T[None]
    forward[starts] = np.broadcast_to(e[starts][:, :, None], (int(starts.sum()), 2, 2))
    forward /= forward.sum(axis=(1, 2), keepdims=True)
    alpha = _scan(forward).sum(axis=2)
    ends = np.append(starts[1:], True)
    nxt = np.vstack([e[1:], np.ones((1, 2))])
    backward = move[None] * nxt[:, None, :]
    backward[ends] = 1.0
    backward /= backward.sum(axis=(1, 2), keepdims=True)
    beta = _scan(backward[::-1]).sum(axis=2)[::-1]
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


#: Emissions of pieces that a Python worker keeps between blocks and tasks, by model.
KEPT_PIECES = 200_000


def _emissions(words: list[str], model: Model) -> np.ndarray:
    name = model.name()
    state = worker_state("toxicity")
    if name not in state:
        state.clear()
        state[name] = {}
    known, weights = state[name], model.weights
    out = [known.get(w) for w in words]
    for i, value in enumerate(out):
        if value is None:
            out[i] = model.bias + sum(weights.get(f, 0.0) for f in features(words[i]))
            if len(known) < KEPT_PIECES and len(words[i]) < 40:
                known[words[i]] = out[i]
    return np.array(out, np.float64)


def tagged(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens of a block, edges of the texts among tokens, and the tokens' code-point edges."""
    words, counts = pieces(column)
    table = words.dictionary.to_pylist()
    codes = words.indices.to_numpy()
    edges = np.append(0, np.cumsum(counts))
    starts = np.zeros(len(codes), bool)
    starts[edges[:-1][counts > 0]] = True
    p = marginals(_emissions(table, model)[codes], starts, model.moves)
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    return p, edges, np.append(0, np.cumsum(sizes[codes]))


def _evidence(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(expected number of toxic tokens, greatest marginal) of each text."""
    sums = np.append(0.0, np.cumsum(p))
    most = np.zeros(len(edges) - 1)
    full = edges[1:] > edges[:-1]
    if full.any():
        most[full] = np.maximum.reduceat(p, edges[:-1][full])
    return np.stack([np.log1p(np.maximum(0, sums[edges[1:]] - sums[edges[:-1]])), most], axis=1)


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple:
    """Logistic weights by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-3, 0.1, 0.1])
        w += np.linalg.solve(hessian, x.T @ (toxic - p) - np.array([1e-3, 0.1, 0.1]) * w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, held_out=None, size: int = SAMPLE) -> Model:
    """A model from the labelled documents for which the condition ``held_out`` on doc_id isn't true."""
    rows = written(sample(docs, labels, held_out, size), "toxic-sample")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        return Model(constant=float(toxic > 0))
    strong = _strong(_feature_counts(rows), clean, toxic)
    drawn = written(_windows(rows, set(strong)), "toxic-windows").orderBy(F.xxhash64("words"), "words", "toxic", "weight").limit(WINDOWS)
    model = fit_chain(sorted((r["words"], r["toxic"], r["weight"]) for r in drawn.collect()), strong)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = _evidence(*tagged(block.column("text"), model)[:2])
            yield pa.record_batch([block.column("toxic"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["toxic", "expected", "most"])

    known = np.array(sorted(map(tuple, rows.mapInArrow(weigh, "toxic int, expected double, most double").collect())))
    model.curve = _curve(known[:, 1:], known[:, 0])
    return model


def scored(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``docs`` with score, predicted, and if asked for ``spans``: (start, end) of toxic runs in code points. Columns of
    these names are replaced."""
    docs = docs.drop("score", "predicted", "spans")
    columns = docs.columns
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if spans:
        pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        extra.append(T.StructField("spans", T.ArrayType(pair)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.curve)
        for block in blocks(batches):
            p, edges, points = tagged(block.column("text"), model)
            if model.constant is None:
                x = np.column_stack([np.ones(len(edges) - 1), _evidence(p, edges)])
                value = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            else:
                value = np.full(len(edges) - 1, model.constant)
            out = [block.column(c) for c in columns] + [pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            if spans:
                hit = np.append(p >= 0.5, False)
                rows = []
                for a, b in zip(edges.tolist(), edges[1:].tolist()):
                    at = np.nonzero(hit[a:b])[0] + a
                    cuts = np.nonzero(np.diff(at) > 1)[0]
                    firsts, lasts = at[np.append(0, cuts + 1)] if len(at) else at, at[np.append(cuts, len(at) - 1)] if len(at) else at
                    rows.append([{"start": int(points[x] - points[a]), "end": int(points[y + 1] - points[a])} for x, y in zip(firsts, lasts)])
                out.append(pa.array(rows, kind))
            yield pa.record_batch(out, columns + ["score", "predicted"] + ["spans"] * spans)

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *extra]))


def held_out_fold():
    """The fold that training never reads: crc32 of the doc_id's digits leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def inner_fold():
    """The part of the training rows on which parameters are chosen: remainder 1, of the rows that aren't held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
