"""Personal data: exact patterns, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by fixed patterns and checks. The model
is there for what these miss. It learns from a bounded sample (``SAMPLE`` documents by a hash of doc_id, ``PER_KIND``
windows of each sort): windows around base spans; the same windows with the span rewritten in a form that the base
can't match (``VARIANTS``: "(at)" for "@", blanks or brackets around an address's dots, other separators between a
card's groups, phones without "+"); windows that hold digits, "@" or brackets but no span; and such windows with a
harmless number or bracket written in. Windows with text that matches a pattern but fails its check, such as a card
number with a typing error, are left out of training, since they are neither.

The model: embeddings of character classes, two LSTMs, scores of begin / inside tags of the four kinds, and transitions,
by exact gradients in numpy. Every text is then covered by windows that overlap by half; each character's tag comes
from the window in which it is most central, and runs of tags over the whole text are the spans. A legal span holds a
digit, "@" or an opening bracket: windows with one of them are decoded, and their neighbours as far as runs of tags
reach, so that skipping the others loses nothing.

Added spans never touch base spans, need a mean tag probability of ``SURE``, and the form and check that their kind asks
for: a card number's digits pass Luhn, an address's parts are at most 255. What a base pattern matches and its check
rejects is not added as a phone either.

Nulls count as empty texts, which have no spans. A text of any length is tagged window by window and is held once.
Repeated rows repeat; ties between windows of equal names in training are broken by their tags. Without base spans in
the sample nothing is added. An empty table gives an empty result. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import blocks, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SAMPLE, PER_KIND, SURE = 4000, 150, 0.7
WIDTH, STRIDE = 48, 24
CELLS, EMBEDDED, EPOCHS, BATCH = 12, 8, 12, 32
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base, in order."""
    found = []
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            least = match.end()
            found.append((start, 0, least))
        at = text.find("@", max(at + 1, least))
    found += [(a, 1, b) for a, b, good in _addresses(text) if good]
    found += [(a, 2, b) for a, b, good in _cards(text) if good]
    found += [(a, 3, b) for a, b, good in _phones(text) if good]
    return sorted(found)


def _octet(part: str) -> bool:
    """Whether a number, with any count of leading zeros, is at most 255."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Matches of four dotted numbers, leftmost first: maximal dotted chains are found once, and each four of a chain's
    numbers are a match, so that long runs of digits cost one pass."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            yield at, end, all(_octet(p) for p in own)
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        yield m.start(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15


def near_misses(text: str) -> list[tuple[int, int]]:
    """Matches of about the right size that fail their check: what they are is not known."""
    found = [(a, b) for a, b, good in _addresses(text) if not good]
    found += [(a, b) for a, b, good in _cards(text) if not good and b - a >= 12]
    return found + [(a, b) for a, b, good in _phones(text) if not good and b - a >= 9]


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


#: Character classes: letters without case, a digit, signs of their own, blanks, line ends, other letters, the rest.
SIGNS = "@.-+()/:_% \n,;[]{}"
CLASSES = 26 + 1 + len(SIGNS) + 2


def _class_table() -> np.ndarray:
    table = np.full(0x110000, CLASSES - 1, np.int8)
    table[0xAA:0x3000] = CLASSES - 2
    for i in range(26):
        table[[65 + i, 97 + i]] = i
    table[48:58] = 26
    for i, sign in enumerate(SIGNS):
        table[ord(sign)] = 27 + i
    return table


CLASS_OF = _class_table()
#: Besides digits, what a span holds at least one of.
SIGNAL = np.array([ord(c) for c in "@([{"], np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(points: np.ndarray) -> np.ndarray:
    """Numbers of the windows of a text that hold a digit, "@" or an opening bracket; window k covers WIDTH characters
    from k * STRIDE."""
    at = np.nonzero(((points >= 48) & (points < 58)) | np.isin(points, SIGNAL))[0]
    if not len(at):
        return at
    return np.unique(np.concatenate([at // STRIDE, np.maximum(at // STRIDE - 1, 0)]))


def _cut(points: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Classes (windows, WIDTH) of the given windows; -1 after the end."""
    place = numbers[:, None] * STRIDE + np.arange(WIDTH)
    inside = place < len(points)
    return np.where(inside, CLASS_OF[points[np.minimum(place, max(0, len(points) - 1))]], -1).astype(np.int8)


def gold_tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int8)
    for a, k, b in spans:
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


@dataclass
class Tagger:
    """Parameters: class scores into each LSTM's gates, recurrent weights, output weights, bias and transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7) -> "Tagger":
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.3, (CLASSES + 1, EMBEDDED)), "moves": np.zeros((TAGS, TAGS)), "bias": np.zeros(TAGS)}
        for side in "fb":
            w["x" + side] = rng.normal(0, 0.3, (EMBEDDED, 4 * CELLS))
            w["h" + side] = rng.normal(0, 0.3, (CELLS, 4 * CELLS))
            w["g" + side] = np.concatenate([np.zeros(CELLS), np.ones(CELLS), np.zeros(2 * CELLS)])
            w["o" + side] = rng.normal(0, 0.3, (CELLS, TAGS))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, codes: np.ndarray, side: str, keep: bool):
        """Hidden states (WIDTH, n, CELLS) of one direction, and what the gradient needs."""
        w = self.weights
        table = (w["embed"] @ w["x" + side] + w["g" + side]).astype(np.float32)
        steps = range(WIDTH) if side == "f" else range(WIDTH - 1, -1, -1)
        n = codes.shape[1]
        h = c = np.zeros((n, CELLS), np.float32)
        out, trace = np.empty((WIDTH, n, CELLS), np.float32), {}
        for t in steps:
            z = table[codes[t]] + h @ w["h" + side]
            np.tanh(z[:, 3 * CELLS :], out=z[:, 3 * CELLS :])
            gates = z[:, : 3 * CELLS]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            before, c = c, gates[:, CELLS : 2 * CELLS] * c + gates[:, :CELLS] * z[:, 3 * CELLS :]
            s = np.tanh(c)
            old, h = h, gates[:, 2 * CELLS :] * s
            out[t] = h
            if keep:
                trace[t] = (z, before, s, old)
        return out, trace

    def scores(self, classes: np.ndarray, keep: bool = False):
        """Tag scores (WIDTH, n, TAGS) of windows of classes (n, WIDTH)."""
        codes = np.ascontiguousarray(classes.T).astype(np.int64) % (CLASSES + 1)
        f, b = self._run(codes, "f", keep), self._run(codes, "b", keep)
        e = f[0] @ self.weights["of"] + b[0] @ self.weights["ob"] + self.weights["bias"]
        return (e, codes, f, b) if keep else e

    def decode(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags by Viterbi and their marginal probabilities (n, WIDTH)."""
        e, moves = self.scores(classes), self.weights["moves"] + LEGAL
        real = (classes.T >= 0)[..., None]
        best, back = e[0] + LEGAL_FIRST, np.empty(e.shape, np.int8)
        for t in range(1, WIDTH):
            paths = best[:, :, None] + moves[None]
            back[t] = np.where(real[t], paths.argmax(axis=1), np.arange(TAGS))
            best = np.where(real[t], paths.max(axis=1) + e[t], best)
        tags = np.zeros((WIDTH, e.shape[1]), np.int8)
        tags[-1] = best.argmax(axis=1)
        for t in range(WIDTH - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), axis=1)[:, 0]
        alpha, beta, total = _lattice(e, moves, real[..., 0])
        chosen = tags[..., None].astype(np.int64)
        p = np.exp(np.take_along_axis(alpha, chosen, 2)[..., 0] + np.take_along_axis(beta, chosen, 2)[..., 0] - total)
        return tags.T, p.T


def _legal() -> tuple[np.ndarray, np.ndarray]:
    """Transitions into an inside tag come from the same kind only."""
    moves = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        moves[:, 2 + 2 * k] = -1e4
        moves[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return moves, np.zeros(TAGS, np.float32)


LEGAL, LEGAL_FIRST = _legal()


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def _lattice(e: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward messages of the chain, and its log normaliser."""
    alpha, beta = e.copy(), np.zeros_like(e)
    for t in range(1, WIDTH):
        alpha[t] = np.where(real[t][:, None], _log_sum(alpha[t - 1][:, :, None] + moves, 1) + e[t], alpha[t - 1])
    for t in range(WIDTH - 2, -1, -1):
        beta[t] = np.where(real[t + 1][:, None], _log_sum(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2), 0.0)
    return alpha, beta, _log_sum(alpha[-1], 1)


def gradient(tagger: Tagger, classes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the gold tags, and its gradient by all parameters."""
    w = tagger.weights
    e, codes, (hf, tf), (hb, tb) = tagger.scores(classes, keep=True)
    n, gold, real = len(classes), gold.T.astype(np.int64), (classes.T >= 0)
    moves = w["moves"] + LEGAL
    alpha, beta, total = _lattice(e, moves, real)
    cols = np.arange(n)
    point = np.take_along_axis(e, gold[..., None], 2)[..., 0] * real
    pair = moves[gold[:-1], gold[1:]] * real[1:]
    loss = float((total - point.sum(0) - pair.sum(0)).mean())
    d = np.exp(alpha + beta - total[None, :, None]) * real[..., None]
    np.subtract.at(d, (np.arange(WIDTH)[:, None], cols, gold), real * 1.0)
    d /= n
    dm = np.zeros_like(moves)
    for t in range(1, WIDTH):
        q = np.exp(alpha[t - 1][:, :, None] + moves + (e[t] + beta[t] - total[:, None])[:, None, :])
        dm += (q * real[t][:, None, None]).sum(0)
    np.subtract.at(dm, (gold[:-1][real[1:]], gold[1:][real[1:]]), 1.0)
    out = {"moves": np.where(LEGAL < 0, 0, dm / n), "bias": d.sum((0, 1)), "embed": np.zeros(w["embed"].shape)}
    for side, h, trace in (("f", hf, tf), ("b", hb, tb)):
        out["o" + side] = np.einsum("tnc,tnk->ck", h, d)
        dh_out = d @ w["o" + side].T
        dz_all = np.zeros((WIDTH, n, 4 * CELLS), np.float32)
        dh, dc = np.zeros((n, CELLS), np.float32), np.zeros((n, CELLS), np.float32)
        dw = np.zeros(w["h" + side].shape)
        for t in reversed(list(trace)):
            z, before, s, old = trace[t]
            i, f, o, g = (z[:, k * CELLS : (k + 1) * CELLS] for k in range(4))
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - s * s)
            dz = dz_all[t]
            dz[:, :CELLS] = dc * g * i * (1 - i)
            dz[:, CELLS : 2 * CELLS] = dc * before * f * (1 - f)
            dz[:, 2 * CELLS : 3 * CELLS] = dh * s * o * (1 - o)
            dz[:, 3 * CELLS :] = dc * i * (1 - g * g)
            dw += old.T @ dz
            dh, dc = dz @ w["h" + side].T, dc * f
        flat = np.eye(CLASSES + 1, dtype=np.float32)[codes.ravel()].T @ dz_all.reshape(-1, 4 * CELLS)
        out["h" + side], out["g" + side] = dw, dz_all.sum((0, 1))
        out["x" + side] = w["embed"].T @ flat
        out["embed"] += flat @ w["x" + side].T
    return loss, out


def train(classes: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Tagger:
    """A tagger fitted by Adam on shuffled batches."""
    tagger, rng = Tagger.new(seed), np.random.default_rng(seed)
    mean = {k: np.zeros(v.shape) for k, v in tagger.weights.items()}
    square = {k: np.zeros(v.shape) for k, v in tagger.weights.items()}
    count = 0
    for epoch in range(epochs):
        order = rng.permutation(len(classes))
        rate = 0.02 * (1 - 0.8 * epoch / epochs)
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            _, grads = gradient(tagger, classes[some], gold[some])
            count += 1
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                step = rate * (mean[k] / (1 - 0.9**count)) / (np.sqrt(square[k] / (1 - 0.99**count)) + 1e-8)
                tagger.weights[k] = (tagger.weights[k] - step).astype(np.float32)
    return tagger


def _joined(sign: str):
    return lambda text, digits: sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


#: Forms of a span that its base pattern doesn't match, by kind: functions of the span and its digits.
VARIANTS = (
    [
        lambda text, digits: text.replace("@", " (at) ").replace(".", " (dot) "),
        lambda text, digits: text.replace("@", "[at]").replace(".", "[dot]"),
        lambda text, digits: text.replace("@", " [at] "),
        lambda text, digits: text.replace("@", "(at)"),
        lambda text, digits: text.replace("@", " {at} ").replace(".", " {dot} "),
        lambda text, digits: text.replace("@", " @ "),
    ],
    [lambda text, digits, sign=sign: text.replace(".", sign) for sign in (" . ", ". ", "[.]", "(.)", " [.] ")],
    [_joined(sign) for sign in (".", "/", "  ", "_", " - ", ". ")],
    [
        lambda text, digits: f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}",
        lambda text, digits: f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}",
        lambda text, digits: f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}",
        lambda text, digits: f"({digits[-10:-7]}) {digits[-7:-4]} {digits[-4:]}",
        lambda text, digits: f"{digits[-10:-7]}/{digits[-7:-4]}-{digits[-4:]}",
        lambda text, digits: f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}",
    ],
)
#: What is written into windows as no personal data.
HARMLESS = ["{y}-{m:02}-{d:02}", "{d}.{m}.{y}", "{m}/{d}/{y}", "{h}:{s:02}", "v{d}.{m}.{h}", "{d},{n:03},{n:03}", "{n}.{d}", "[{d}]", "({y})", "{y}-{z}", "{d} x {m}", "{n}%", "({m})", "{k}", "No. {k}", "{d} {n:03} {n:03}", "(see {d}.{m})", "[note {d}]", "@{d}"]


def _harmless(rng: np.random.Generator) -> str:
    y, m, d, h, s, n, k = rng.integers([1900, 1, 1, 0, 0, 0, 0], [2100, 13, 32, 24, 60, 1000, 99999999]).tolist()
    return HARMLESS[rng.integers(len(HARMLESS))].format(y=y, z=y + d % 9, m=m, d=d, h=h, s=s, n=n, k=k)


def rewritten(text: str, rng: np.random.Generator) -> list[tuple[int, str, int, int]]:
    """(kind, context, start, end): spans of a text in forms that the base doesn't match, each with about a window of
    the text on both sides. Spans that have others close by are left out."""
    base, out = base_spans(text), []
    near = sorted([(a, b) for a, _, b in base] + near_misses(text))
    for a, kind, b in base:
        left, right = max(0, a - WIDTH - int(rng.integers(STRIDE))), b + WIDTH
        if sum(x < right and left < y for x, y in near) > 1:
            continue
        digits = "".join(c for c in text[a:b] if "0" <= c <= "9")
        form = VARIANTS[kind][rng.integers(len(VARIANTS[kind]))](text[a:b], digits)
        context = text[left:a] + form + text[b:right]
        if not any(k == kind and x < a - left + len(form) and a - left < y for x, k, y in base_spans(context)):
            out.append((kind, context, a - left, a - left + len(form)))
    return out


#: Sorts of training windows: 0 has no span, 1 to 4 base spans by kind, 5 to 8 rewritten ones, 9 something harmless.
SORTS = 2 + 2 * len(KINDS)


def _labelled(docs: DataFrame) -> DataFrame:
    """(sort, name, classes, tags) of training windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows: list[tuple[int, bytes, bytes]] = []

            def take(text: str, spans, shift: int = 0, only=None, unsure=()) -> None:
                points = _points(text)
                numbers = windows(points)
                if not len(numbers):
                    return
                gold = gold_tags(len(points), spans)
                for k, row in zip(numbers.tolist(), _cut(points, numbers)):
                    low, high = k * STRIDE, k * STRIDE + WIDTH
                    if only and (high <= only[0] or only[1] <= low) or any(a < high and low < b for a, b in unsure):
                        continue
                    own = np.zeros(WIDTH, np.int8)
                    piece = gold[low:high]
                    own[: len(piece)] = piece
                    sort = int((own.max() + 1) // 2) + shift if own.any() else SORTS - 1 if only else 0
                    rows.append((sort, row.tobytes(), own.tobytes()))

            for text in block.column("text").to_pylist():
                text = text or ""
                take(text, base_spans(text), unsure=near_misses(text))
                rng = np.random.default_rng(int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "little"))
                for kind, context, a, b in rewritten(text, rng):
                    take(context, [(a, kind, b)], len(KINDS), (a, b))
                at = int(rng.integers(len(text) + 1))
                before, after, form = text[max(0, at - WIDTH) : at], text[at : at + WIDTH], _harmless(rng)
                context = f"{before} {form} {after}"
                take(context, base_spans(context), 0, (len(before) + 1, len(before) + 1 + len(form)), near_misses(context))
            names = [hashlib.md5(r[1]).hexdigest() for r in rows]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array(names, pa.string())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)],
                ["sort", "name", "classes", "tags"],
            )

    return docs.mapInArrow(cut, "sort int, name string, classes binary, tags binary")


def training_windows(docs: DataFrame, size: int = SAMPLE, per_kind: int = PER_KIND) -> list:
    """Rows (sort, classes, tags) to learn from: at most ``per_kind`` of each sort of span and three times as many of
    each sort without, the first by a hash of the window."""
    chosen = docs.where("text IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # ``size`` ids: bounded by a parameter, so broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("text")
    found = written(_labelled(sample), "pii-windows").dropDuplicates(["sort", "name", "tags"])
    nth = F.row_number().over(Window.partitionBy("sort").orderBy("name", "tags"))
    most = F.when(F.col("sort").isin(0, SORTS - 1), 3 * per_kind).otherwise(per_kind)
    return found.withColumn("nth", nth).where(F.col("nth") <= 3 * per_kind).where(F.col("nth") <= most).orderBy("sort", "nth").collect()


def fit(docs: DataFrame, size: int = SAMPLE, per_kind: int = PER_KIND, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger trained on windows of ``size`` documents; None if they hold no base spans."""
    rows = training_windows(docs, size, per_kind)
    if not any(0 < r["sort"] < SORTS - 1 for r in rows):
        return None
    classes, tags = (np.frombuffer(b"".join(r[c] for r in rows), np.int8).reshape(-1, WIDTH) for c in ("classes", "tags"))
    # a window may begin inside a span; its first tag then begins one
    tags = tags.copy()
    first = tags[:, 0]
    tags[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
    return train(classes, tags, epochs)


#: Forms of added spans: "@" or a bracketed "at", a dot or a bracketed "dot", and numbers with separators.
AT_FORM = re.compile(r"@|[(\[{] ?at ?[)\]}]", re.IGNORECASE)
DOT_FORM = re.compile(r"\.|[(\[{] ?dot ?[)\]}]", re.IGNORECASE)
NUMBER_FORM = re.compile(r"[0-9 ()\[\].+/_-]+")


def _asked(kind: int, text: str) -> bool:
    """What a kind asks of an added span: the checks of the base hold for other forms as well."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        parts = AT_FORM.split(text)
        return len(parts) == 2 and bool(parts[0].strip()) and bool(DOT_FORM.search(parts[1].strip(" .")))
    if not NUMBER_FORM.fullmatch(text) or not ("0" <= text[-1] <= "9"):
        return False
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(_octet(p) for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(text)


def _rejected(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Addresses and phones that their checks reject, in or about a span."""
    low = max(0, start - WIDTH)
    near = text[low : end + WIDTH]
    return [(low + a, low + b) for found in (_addresses(near), _phones(near)) for a, b, good in found if not good]


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger adds to each text of a block: those of all windows, though only windows that hold a digit,
    "@" or a bracket, and neighbours that a run of tags reaches into, are decoded."""
    points = [_points(t) for t in texts]
    todo = [(i, k) for i, k in enumerate(map(windows, points)) if len(k)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tagged = {i: (np.zeros(len(points[i]) + 1, np.int8), np.zeros(len(points[i])), np.zeros(len(points[i]) + 1, bool)) for i, _ in todo}
    done = {i: np.zeros(0, np.int64) for i in tagged}
    quarter = (WIDTH - STRIDE) // 2
    while todo:
        classes = np.concatenate([_cut(points[i], own) for i, own in todo])
        # equal windows decode equally, once
        _, first, again = np.unique(np.ascontiguousarray(classes).view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
        parts = [tagger.decode(classes[first[a : a + 4000]]) for a in range(0, len(first), 4000)]
        tags = np.concatenate([p[0] for p in parts])[again]
        sure = np.concatenate([p[1] for p in parts])[again]
        at, further = 0, []
        for i, own in todo:
            n, (kind, p, head) = len(points[i]), tagged[i]
            for j, k in enumerate(own.tolist()):
                low = 0 if k == 0 else k * STRIDE + quarter
                high = min(n, k * STRIDE + quarter + STRIDE)
                if low >= high:
                    continue
                piece = slice(low - k * STRIDE, high - k * STRIDE)
                row = tags[at + j][piece]
                kind[low:high], p[low:high] = (row + 1) // 2, sure[at + j][piece]
                head[low:high] = row % 2 == 1
            at += len(own)
            done[i] = np.union1d(done[i], own)
            right = done[i][done[i] * STRIDE + quarter + STRIDE < n]
            left = done[i][(done[i] > 0) & (done[i] * STRIDE + quarter < n)]
            low = left * STRIDE + quarter
            reached = np.concatenate([right[kind[right * STRIDE + quarter + STRIDE - 1] > 0] + 1, left[(kind[low] > 0) & ~head[low]] - 1])
            reached = np.setdiff1d(reached, done[i])
            if len(reached):
                further.append((i, reached))
        todo = further
    for i, (kind, p, head) in tagged.items():
        n = len(points[i])
        start = np.nonzero((kind[:-1] > 0) & (head[:-1] | (np.append(0, kind[:-2]) != kind[:-1])))[0]
        for a in start.tolist():
            b = a + 1
            while b < n and kind[b] == kind[a] and not head[b]:
                b += 1
            text = texts[i][a:b]
            left, right = len(text) - len(text.lstrip()), len(text.rstrip())
            k = int(kind[a]) - 1
            if k == 1 and not _asked(1, text.strip()):
                k = 3  # dotted groups that are no address may be a phone
            if p[a:b].mean() < SURE or not _asked(k, text.strip()) or any(x < a + right and a + left < y for x, _, y in base[i]):
                continue
            if k == 3 and any(x < a + right and a + left < y for x, y in _rejected(texts[i], a + left, a + right)):
                continue
            out[i].append((a + left, k, a + right))
    return out


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest are of the base."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [t or "" for t in block.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, tagger) if tagger else [[] for _ in texts]
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(len(KINDS))]
            yield pa.record_batch(
                [block.column("doc_id"), *counts, pa.array([hashlib.sha256(named(x).encode()).hexdigest() for x in base], pa.string()), pa.array([named(x + y) for x, y in zip(base, more)], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(search, schema)
