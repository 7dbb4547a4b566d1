"""Top-k by slices, spelling variants and the conversation trie against brute force, with nulls, ties, repeats, empty
tables, long values and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import prefix_trie, spelling_groups, topk_slices

from pyspark.sql import functions as F

from .test_operators import frame


# 11 ------------------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, rank int, score string"


def best_by_force(rows, k=10):
    """Lists (query_id, rank, vec_id, score), one for each query row."""
    whole = [(i, n, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v in whole:
        if i is None or i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for j, m, w in whole if m != n and len(w) == len(v)]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "s") for i, v in rows], VECTORS).repartition(3)


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(600)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # ties
    rows += [(200, rows[200][1]), (200, rows[3][1]), (-300, rows[5][1]), (None, rows[100][1]), (None, rows[7][1])]
    rows += [(700, None), (701, [None] * 12), (702, [float("nan")] * 12), (800, [float("inf")] + [0.0] * 11), (703, rows[1][1][:5]), (900, rows[2][1][:5]), (901, []), (1100, [])]
    rows += [(1200, [0.0] * 12), (1300, [-1.5] * 12)]
    for block, chunk in ((1 << 14, 64), (50, 2)):
        found = topk_slices.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, block=block, chunk=chunk)
        assert sorted((tuple(r) for r in found.collect()), key=str) == best_by_force(rows)
    nothing = topk_slices.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0)
    assert nothing.count() == 0 and nothing.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk_slices.top_k(vectors(spark, rows[1:20]), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([2, 9, 12]) for _ in range(4)]) for i in range(300)]
    found = topk_slices.top_k(vectors(spark, rows), F.col("vec_id") == 0).collect()
    wanted = [r for r in best_by_force(rows) if r[0] == 0]
    clipped = sorted((i, r, j, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, r, j, s in wanted)
    assert sorted(map(tuple, found)) == clipped


@pytest.mark.parametrize("slices", [1, 3, 8, 20])
def test_slices_keep_all_that_can_be_best(slices):
    rng = np.random.default_rng(slices)
    for _ in range(30):
        values = rng.integers(-900, 900, (rng.integers(1, 200), 6))
        index, query = topk_slices.Index(values, slices), rng.integers(-900, 900, 6)
        exact = values @ query
        kept = set(index.candidates(query, 10).tolist())
        least = np.sort(exact)[-min(10, len(exact))]
        assert set(np.nonzero(exact >= least)[0].tolist()) <= kept
        if slices == 20 and len(exact) > 10:  # nothing is dropped: the slices' sums are the scores
            assert kept == set(np.nonzero(exact >= least)[0].tolist())


# 12 ------------------------------------------------------------------------------------------------------------------
def words_by_force(rows):
    import re

    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            if len(low) >= 7:
                counts[low] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = defaultdict(set)
    parts = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            parts[less, k].add(w)
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for group in parts.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root))
    return sorted(out)


def test_spelling_groups(spark):
    rng = random.Random(3)
    letters = "abdeginorstuéüÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(60)]
    base += ["ab" * 20, "ab" * 20 + "a", "ba" * 20, "x" * 900, "x" * 901, "x" * 450 + "y" + "x" * 449, "aaaaaaa", "aaaaaab", "aaaaaac", "aaaaaaaa"]

    def edited(w):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:k] + (rng.choice(letters) if kind else "") + w[k + (kind != 1) :]

    rows = []
    for i in range(400):
        some = [rng.choice(base) for _ in range(rng.randint(0, 30))] + [base[i % 7]] * (i % 9)
        some = [w if rng.random() < 0.7 else edited(w) for w in some]
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in some)))
    rows += [(1000, None), (1001, ""), (1002, "12 -- 中文"), (1003, base[0] + "'" + base[1]), (1003, base[0] + "'" + base[1])]
    docs = frame(spark, rows).repartition(4)
    wanted = words_by_force(rows)
    for shard in (1 << 15, 25):
        found = spelling_groups.spelling_groups(docs, shard=shard).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(map(tuple, found.collect())) == wanted
    assert sum(r[2] for r in wanted) > 100 and any(r[3] for r in wanted)
    assert spelling_groups.spelling_groups(frame(spark, [])).count() == 0
    assert spelling_groups.spelling_groups(frame(spark, [(1, "short 12"), (2, None)])).count() == 0


def test_long_chains_of_forms_end_in_their_root(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(zip(chain, (2, 30, 400, 5000)))]
    rows = [(k, t) for k, t in rows if all(zlib.crc32(f"{k}:{w}".encode()) % 31 for w in chain)]
    found = {r.word: r.root for r in spelling_groups.spelling_groups(frame(spark, rows)).collect()}
    assert found == {w: words for (w, *_, words) in words_by_force(rows)} and len(rows) >= 3


def test_shards_are_those_of_the_search():
    """Every leaf that the trie's search finds lies in a shard that routing reaches."""
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcdeint"), rng.integers(3, 9))) for _ in range(3000)})
    import pyarrow as pa

    found = spelling_groups.vectors(*spelling_groups.latin(pa.array(words)))
    order = np.lexsort(found.T[::-1])
    found = found[order]
    trie = spelling_groups.Trie(found)
    who, leaf, _ = trie.search(found)
    for size in (1, 7, 100, 5000):
        firsts = found[size::size]
        reached = set(zip(*(x.tolist() for x in spelling_groups.shards_reached(firsts, found))))
        for w, at in zip(who.tolist(), leaf.tolist()):
            places = range(trie.starts[at] // size, (trie.starts[at + 1] - 1) // size + 1)
            assert all((w, s) in reached for s in places)


# 13 ------------------------------------------------------------------------------------------------------------------
CHATS = "conv_id long, turn long, role string, text string, depth int, key string"


def trie_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role or "", digest, text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
        for d in range(len(full) + 1):
            nodes.setdefault(full[:d], []).append((c, d == len(full)))
    kids = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        size = len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(members) - 1) * size
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, e in members if e))
        out.append((min(c for c, _ in members), len(n), min(c for c, _ in nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(rng, count):
    pool = [("user", f"q{k}") for k in range(3)] + [("assistant", "a" * k) for k in range(3)] + [(None, None), ("", "éé")]
    rows = []
    for c in range(count):
        rows += [(c, rng.choice([t, None]), *rng.choice(pool)) for t in range(rng.choice([1, 2, 3, 5, 12]))]
    return rows


def test_prefix_trie(spark):
    rng = random.Random(12)
    rows = chats(rng, 150)
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1200) for t in range(12)]  # one large group of copies
    rows += [(c, t, "user", f"same {t}") for c in range(1200, 1203) for t in range(14)]  # that longer ones go on from
    rows += [(5003, t, "user", "x") for t in range(2)] + [(5004, 0, "user", "x"), (5004, 0, "user", "x"), (-7, 1, "user", "y"), (None, 1, "user", "z")]
    rows += [(7000, t, "user", "long " * (t % 3)) for t in range(700)]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], CHATS).repartition(5)
    wanted = trie_by_force(rows)
    for shard in (4096, 40, 3):
        found = prefix_trie.prefix_trie(table, shard)
        assert sorted(map(tuple, found.collect()), key=str) == wanted
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_copies_across_many_shards(spark):
    """Shards that hold nothing but copies: the leaf is known only after the reduction, and its ends are hashed in order."""
    rows = [(c * 5, t, "user", f"{t}") for c in range(64) for t in range(3)] + [(1000, 0, "user", "other")]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], CHATS).repartition(3)
    assert sorted(map(tuple, prefix_trie.prefix_trie(table, 5).collect()), key=str) == trie_by_force(rows)
    old, prefix_trie.PIECE = prefix_trie.PIECE, 2
    try:
        assert sorted(map(tuple, prefix_trie.prefix_trie(table, 5).collect()), key=str) == trie_by_force(rows)
    finally:
        prefix_trie.PIECE = old
