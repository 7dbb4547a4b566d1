"""Exact vector search with scopes, rank fusion, merging of candidate lists.

Candidates are rows (query_id, id, distance or rank); order is always an explicit column, ties go to the lesser id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of queries and of chunks, queries that are multiplied at once, and pairs that are summed at once.
QUERY_BLOCK, CHUNK_BLOCK, STRIP, PAIRS = 8192, 8192, 256, 1 << 21
#: Chunks of which only the nearest counts for the bound on what may be among the first.
GROUP = 16


def metadata_filter(condition: dict) -> Column:
    """A Column from a nested filter: {key: value}, {key: {"$eq": v}}, {key: {"$in": [...]}}, "$and", "$or". Several
    keys must all hold; values compare as strings; other operators raise ValueError."""

    def one(key: str, value) -> Column:
        if key in ("$and", "$or"):
            joined = [metadata_filter(x) for x in value]
            return reduce(lambda a, b: a & b if key == "$and" else a | b, joined)
        if isinstance(value, dict):
            ((operator, operand),) = value.items()
            if operator == "$in":
                return F.col(key).cast("string").isin([str(x) for x in operand])
            if operator != "$eq":
                raise ValueError(f"operator {operator} isn't supported")
            value = operand
        return F.col(key).cast("string") == str(value)

    if not condition:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [one(k, v) for k, v in condition.items()])


def ranked(df: DataFrame, by: list, most: int | None = None, partition: str = "query_id", name: str = "rank") -> DataFrame:
    """``rank`` from 1 within each query; a limit becomes a group limit before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(partition).orderBy(*by)))
    return out if most is None else out.where(F.col(name) <= most)


def nearest(queries: DataFrame, chunks: DataFrame, scope: str, most: int) -> DataFrame:
    """(query_id, id, distance, rank): exact neighbours within the query's scope.

    ``queries``: query_id, scope, query_vector; ``chunks``: id, scope, vector. Both sides of a scope are cut into blocks
    of bounded size, so that every query block meets every chunk block once; a pair of blocks keeps ``most`` rows a query.
    Null components count in no distance; vectors without any in common are null apart, and come last.
    """
    q_parts = queries.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_parts"))
    c_parts = chunks.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / CHUNK_BLOCK).cast("int").alias("c_parts"))
    parts = q_parts.join(c_parts, scope)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(parts, scope).select(F.col(scope).alias("asked_scope"), own("query_id", "q_parts").alias("q_part"), each("c_parts").alias("c_part"), "query_id", "query_vector")
    held = chunks.join(parts, scope).select(F.col(scope).alias("held_scope"), each("q_parts").alias("q_part"), own("id", "c_parts").alias("c_part"), "id", "vector")
    schema = T.StructType([queries.schema["query_id"], chunks.schema["id"], T.StructField("distance", T.DoubleType())])
    found = asked.groupBy("asked_scope", "q_part", "c_part").cogroup(held.groupBy("held_scope", "q_part", "c_part")).applyInArrow(_block_search(most), schema)
    return ranked(found, [F.asc_nulls_last("distance"), "id"], most)


def _block_search(most: int):
    """A function of two Arrow tables, queries and chunks: each query's ``most`` rows of least distance, then of least id."""
    strip_rows, at_once, most_in_group = STRIP, PAIRS, GROUP

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, and which components there are; shorter vectors and null ones are filled up with absent ones."""
        lists = column.combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        there = np.arange(width) < sizes[:, None]
        flat = lists.flatten()
        values, present = np.zeros((len(sizes), width)), np.zeros((len(sizes), width), bool)
        values[there] = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
        present[there] = flat.is_valid().to_numpy(zero_copy_only=False)
        return values, present

    def distances(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
        """Sums in order of components, as a row by row evaluation gives them."""
        total = np.zeros(len(qi))
        for a, b in zip(q.T, c.T):
            apart = a[qi] - b[ci]
            total += apart * apart
        return total

    def partial(q, q_there, c, c_there, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, absent) of one query and all chunks, where components may be absent or infinite."""
        total, any_there = np.zeros(len(c)), np.zeros(len(c), bool)
        with np.errstate(all="ignore"):
            for k in range(c.shape[1]):
                both = c_there[:, k] & q_there[i, k]
                apart = q[i, k] - c[:, k]
                total += np.where(both, apart * apart, 0.0)
                any_there |= both
        return total, ~any_there

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not len(asked) or not len(held):
            return pa.table([asked["query_id"].slice(0, 0), held["id"].slice(0, 0), pa.array([], pa.float64())], names=names)
        held = held.take(pc.array_sort_indices(held["id"].combine_chunks(), null_placement="at_start"))
        width = max(int(pc.max(pc.list_value_length(t[n])).as_py() or 0) for t, n in ((asked, "query_vector"), (held, "vector")))
        (q, q_there), (c, c_there) = matrix(asked["query_vector"], width), matrix(held["vector"], width)
        with np.errstate(all="ignore"):
            q_size, c_size = (q * q).sum(axis=1), (c * c).sum(axis=1)
        plain = width and q_there.all() and c_there.all() and np.isfinite(q_size).all() and np.isfinite(c_size).all() and max(q_size.max(), c_size.max()) < 1e300
        found = []
        if plain:
            # near misses by products of matrices: what may be among the first by their bound on errors is summed in order
            off = 8 * (width + 8) * np.finfo(float).eps * (np.sqrt(q_size) + np.sqrt(c_size.max())) ** 2
            keep = max(1, min(most, len(c)))
            # the keep-th least of the groups' minima is no less than the keep-th least of all, and few lie between them
            group = min(most_in_group, len(c) // keep)
            groups = len(c) // group
            turned = -2.0 * c.T
            for start in range(0, len(q), strip_rows):
                strip = slice(start, start + strip_rows)
                near = q[strip] @ turned
                near += c_size
                least = near[:, :groups].copy()
                for n in range(1, group):
                    np.minimum(least, near[:, n * groups : (n + 1) * groups], out=least)
                worst = np.partition(least, keep - 1, axis=1)[:, keep - 1]
                qi, ci = np.divmod(np.flatnonzero(near <= (worst + 2 * off[strip])[:, None]), len(c))
                for rows in np.split(np.arange(len(qi)), np.searchsorted(qi, np.arange(1, int(qi[-1]) + 1))) if len(qi) > at_once else [np.arange(len(qi))]:
                    one, other = qi[rows] + start, ci[rows]
                    apart = distances(q, c, one, other)
                    order = np.lexsort((other, apart, one))
                    one, other, apart = one[order], other[order], apart[order]
                    place = np.arange(len(one)) - np.searchsorted(one, one)
                    first = place < most
                    found.append((one[first], other[first], apart[first], np.zeros(int(first.sum()), bool)))
        else:
            for i in range(len(q)):
                apart, absent = partial(q, q_there, c, c_there, i)
                order = np.lexsort((np.arange(len(c)), apart, np.isnan(apart), absent))[:most]
                found.append((np.full(len(order), i), order, apart[order], absent[order]))
        one, other, apart, absent = (np.concatenate(x) for x in zip(*found))
        return pa.table([asked["query_id"].take(pa.array(one)), held["id"].take(pa.array(other)), pa.array(apart, pa.float64(), mask=absent)], names=names)

    return search


def diverse(candidates: DataFrame, section: str, most: int) -> DataFrame:
    """The best candidate of each section, then the first ``most`` of them: ``place`` is the new rank."""
    nth = F.row_number().over(Window.partitionBy("query_id", section).orderBy("rank"))
    best = candidates.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return ranked(best, ["rank"], most, name="place")


def fused(rankings: list[DataFrame], most: int, k: int = 60) -> DataFrame:
    """(query_id, id, score, place): reciprocal rank fusion of rankings (query_id, id, rank)."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "id", "rank").withColumn("list", F.lit(i)) for i, r in enumerate(rankings)])
    scores = every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return ranked(scores, [F.round("score", 12).desc(), "seen", "id"], most, name="place").drop("seen")


def first_wins(lists: list[DataFrame], most: int | None = None) -> DataFrame:
    """Union of candidate lists (query_id, id, rank); an id keeps its first place, ``place`` counts anew."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank").withColumn("list", F.lit(i)) for i, x in enumerate(lists)])
    kept = every.groupBy("query_id", "id").agg(F.min(F.struct("list", "rank")).alias("seen"))
    return ranked(kept.select("query_id", "id", "seen"), ["seen", "id"], most, name="place").select("query_id", "id", F.col("seen.list").alias("list"), "place")


def least_distance(candidates: DataFrame) -> DataFrame:
    """One row per query and id over several searches: the least distance."""
    return candidates.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def with_fallback(found: DataFrame, queries: DataFrame, fallback) -> DataFrame:
    """Results, and for queries without any those of ``fallback(queries)``."""
    missing = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(fallback(missing))


def reranked(candidates: DataFrame, replies: DataFrame, pool: int, most: int, none_is_empty: bool = False) -> DataFrame:
    """(query_id, id, place): candidates (query_id, id, rank) in the order that a reply (query_id, reply) gives.

    A reply numbers the pool's candidates from 0. Queries with ``most`` candidates or fewer keep their order, and so do
    queries without a usable reply, unless ``none_is_empty``.
    """
    held = candidates.where(F.col("rank") <= pool).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("held"))
    both = held.join(replies, "query_id", "left").withColumn("n", F.size("held"))
    numbers = F.filter(F.transform(F.regexp_extract_all(F.coalesce("reply", F.lit("")), F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int")), lambda x: x < F.col("n"))
    chosen = F.slice(F.array_distinct(numbers), 1, most)
    own = F.slice(F.sequence(F.lit(0), F.col("n") - 1), 1, most)
    usable = (F.size(chosen) > 0) & (F.col("n") > most)
    order = F.when(usable, chosen).when((F.col("n") > most) & F.lit(none_is_empty), F.array().cast("array<int>")).otherwise(own)
    return both.select("query_id", "held", F.posexplode(order).alias("at", "i")).select(
        "query_id", F.get("held", F.col("i"))["id"].alias("id"), (F.col("at") + 1).alias("place")
    )


def pointwise(candidates: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """(query_id, id, distance, place) by a score table (query_id, id, p): distance is 1 - p."""
    return ranked(candidates.select("query_id", "id").join(scores, ["query_id", "id"]).select("query_id", "id", (1 - F.col("p")).alias("distance")), ["distance", "id"], most, name="place")
