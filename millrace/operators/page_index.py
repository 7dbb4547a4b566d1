"""Which page of a document holds a passage: an inverted table of sampled windows of the pages, and equality joins.

Of every ``WINDOW`` characters in a row, the start with the least hash of its next ``GRAM`` characters is an anchor
(ties: the first). A passage of at least ``WINDOW`` characters has an anchor in its first ``WINDOW``, and wherever a page
holds the passage it has the same anchor there. So anchors are joined by equality, each meeting names one place, and the
page's text is compared there once. Pages keep about a fifth of their places as anchors.

Passages shorter than ``WINDOW`` are looked for in all pages of their document; they can't be but at texts' ends, and
callers try longer ones first.

Where pieces ask for pages of their own document, both are brought together by document (``_looked_up``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as letters

WINDOW, GRAM = 18, 10
_BASE = np.uint64(0x9E3779B97F4A7C15)


def anchors(text: str, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = len(points) - gram + 1
    if len(points) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = np.zeros(count, np.uint64)
        for k in range(gram):
            hashes = hashes * _BASE + points[k : k + count]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window - gram + 1)
    places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return places, hashes[places].view(np.int64)


def with_anchors(rows: DataFrame, columns: list[str], text: str, first: bool = False) -> DataFrame:
    """(*columns, place, anchor): a row for each anchor of a text, or of its first ``WINDOW`` characters."""
    kept = rows.select(*columns, F.substring(F.col(text), 1, WINDOW).alias("__text") if first else F.col(text).alias("__text")).where(F.length("__text") >= WINDOW)
    schema = T.StructType([*rows.select(*columns).schema.fields, T.StructField("place", T.LongType()), T.StructField("anchor", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t) for t in batch.column("__text").to_pylist()]
            own = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            ids = batch.select(columns).take(pa.array(own))
            places, hashes = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.record_batch([*ids.columns, pa.array(places), pa.array(hashes)], [*columns, "place", "anchor"])

    return kept.mapInArrow(find, schema)


def holding_pages(probes: DataFrame, pages: DataFrame, key: list[str], probe_key: list[str], within: Column | None = None) -> DataFrame:
    """(*key, *probe_key, page): every page (*key, page, text) that holds a probe (*key, *probe_key, probe, ...).

    ``within``: a condition on ``page`` and the probes' other columns that candidates must meet before texts are read.
    """
    own = [*key, *probe_key]
    rest = [c for c in probes.columns if c not in own and c != "probe"]
    index = with_anchors(pages, [*key, "page"], "text").withColumnRenamed("place", "page_place")
    asked = with_anchors(probes, [*own, *rest, "probe"], "probe", first=True)
    met = asked.join(index, [*key, "anchor"])
    if within is not None:
        met = met.where(within)
    met = met.select(*own, "probe", "page", (F.col("page_place") - F.col("place")).alias("at")).where("at >= 0")
    # probes are short: they go to the pages, whose texts move once and end here
    texts = pages.select(*key, "page", "text")
    found = met.join(texts, [*key, "page"]).where(F.substring(F.col("text"), (F.col("at") + 1).cast("int"), F.length("probe")) == F.col("probe")).select(*own, "page")
    short = probes.where((F.length("probe") < WINDOW) & (F.length("probe") > 0)).join(texts, key).where(F.contains("text", "probe"))
    if within is not None:
        short = short.where(within)
    return found.unionByName(short.select(*own, "page")).distinct()


#: Texts of a document up to so many characters are searched as they are, longer ones by their anchors.
DIRECT = 1 << 17


class Pages:
    """The pages of one document in order, as one text with line ends between them, which neither pages nor probes hold."""

    def __init__(self, numbers: list[int], texts: list[str]):
        order = sorted(range(len(numbers)), key=numbers.__getitem__)
        self.numbers, self.begins, at = [numbers[i] for i in order], [0], 0
        for i in order:
            at += len(texts[i]) + 1
            self.begins.append(at)
        self.text, self.index = "\n".join([texts[i] for i in order]), None

    def first(self, probe: str, low: int | None = None, high: int | None = None) -> int | None:
        """The first page from ``low`` to ``high`` that holds the probe."""
        begin = 0 if low is None else self.begins[bisect_left(self.numbers, low)]
        end = len(self.text) if high is None else self.begins[bisect_right(self.numbers, high)] - 1
        at = self.text.find(probe, begin, end) if min(end - begin, len(probe) - WINDOW + DIRECT) <= DIRECT else self._anchored(probe, begin, end)
        return None if at < 0 or begin >= end else self.numbers[bisect_right(self.begins, at) - 1]

    def _anchored(self, probe: str, begin: int, end: int) -> int:
        if self.index is None:
            places, hashes = anchors(self.text)
            order = np.argsort(hashes, kind="stable")
            self.index = places[order], hashes[order]
        (place,), (hashed,) = anchors(probe[:WINDOW])
        low, high = (np.searchsorted(self.index[1], hashed, side) for side in ("left", "right"))
        found = self.index[0][low:high] - place
        low, high = np.searchsorted(found, (begin, end - len(probe) + 1))
        return next((at for at in map(int, found[low:high]) if self.text.startswith(probe, at)), -1)


def _looked_up(pieces: DataFrame, pages: DataFrame, key: list[str], columns: list[str], look: Callable[..., tuple[int | None, int | None]]) -> DataFrame:
    """(*key, piece_no, page_start, page_end) of pieces (*key, piece_no, *columns): what ``look`` finds in the ``Pages`` of
    the piece's document, given its columns.

    A document's pages and its pieces are one row each, so texts are moved once, and nothing is joined by text. A document
    has to fit a task; a long one is searched through its anchors, in time that grows with its length.
    """
    asked = pieces.groupBy(*key).agg(F.collect_list(F.struct("piece_no", *columns)).alias("__pieces"))
    texts = pages.where(F.col("page").isNotNull() & F.col("text").isNotNull()).groupBy(*key).agg(F.collect_list(F.struct("page", "text")).alias("__pages"))
    both = asked.join(texts, key, "left").select(*key, "__pieces", "__pages")
    named = [*(both.schema[c] for c in key), pieces.schema["piece_no"]]
    schema = T.StructType([*named, T.StructField("page_start", T.LongType()), T.StructField("page_end", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, held = batch.column("__pieces"), batch.column("__pages")
            rows, own = lists.flatten(), lists.value_lengths().fill_null(0).to_pylist()
            texts, sizes = held.flatten(), held.value_lengths().fill_null(0).to_pylist()
            numbers, texts = texts.field("page").to_pylist(), texts.field("text").to_pylist()
            asked = list(zip(*(rows.field(c).to_pylist() for c in columns)))
            found, at, text_at = [], 0, 0
            for n, size in zip(own, sizes):
                document = Pages(numbers[text_at : text_at + size], texts[text_at : text_at + size])
                found += [look(document, *asked[i]) for i in range(at, at + n)]
                at, text_at = at + n, text_at + size
            ids = batch.select(key).take(pa.array(np.repeat(np.arange(len(own)), own)))
            pages_found = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.record_batch([*ids.columns, rows.field("piece_no"), *pages_found], [*key, "piece_no", "page_start", "page_end"])

    return both.mapInArrow(find, schema)


#: Lengths of the starts and ends of a piece that are looked for, and the windows after its start.
LENGTHS, LATER, LATER_WIDTH = (120, 80, 40, 20), (30, 60, 90), 30


def assigned_pages(pieces: DataFrame, pages: DataFrame, key: list[str], piece: str) -> DataFrame:
    """(*key, piece_no, page_start, page_end) of pieces (*key, piece_no, piece); both null if no probe is found.

    ``page_start`` is the first page that holds the longest findable start of the piece, blanks aside, or one of the
    windows after it; ``page_end`` the first one from there on that holds the longest findable end, else the same page.
    """
    own = [*key, "piece_no"]
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    body = pieces.select(*own, F.coalesce(bare(F.col(piece)), F.lit("")).alias("b"))
    body = body.withColumn("b", F.when(F.col("b").startswith("증상:"), F.substring(F.col("b"), F.lit(4), F.length("b"))).otherwise(F.col("b")))
    most = max(*LENGTHS, *(k + LATER_WIDTH for k in LATER))
    ends = body.select(*own, F.substring("b", 1, most).alias("head"), F.when(F.length("b") <= most, F.col("b")).otherwise(F.substring("b", -most, most)).alias("tail"))
    squeezed = pages.select(*key, "page", bare(F.col("text")).alias("text"))

    def look(document: Pages, head: str, tail: str) -> tuple[int | None, int | None]:
        for probe in (*(head[:n] for n in LENGTHS), *(head[k : k + LATER_WIDTH] for k in LATER)):
            if probe and (start := document.first(probe)) is not None:
                break
        else:
            return None, None
        for n in LENGTHS:
            if (end := document.first(tail[-n:], start)) is not None:
                return start, end
        return start, start

    kind = pages.schema["page"].dataType
    return _looked_up(ends, squeezed, key, ["head", "tail"], look).select(*own, F.col("page_start").cast(kind), F.col("page_end").cast(kind))


#: Width of the probes at look-up, where they begin, least text, and pages looked at.
PROBE, OFFSET, LEAST, FORWARD = 18, 10, 40, 15


def located_pages(pieces: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """(*key, piece_no, page_start, page_end) of pieces (*key, piece_no, body, claimed): two probes, near the start and
    the end of the letters and digits, looked for from the claimed page up to ``FORWARD`` pages on; else as claimed."""
    own = [*key, "piece_no"]
    bare = lambda c: F.regexp_replace(c, letters.OTHERS, "")
    rows = pieces.select(*own, "claimed", bare(F.col("body")).alias("b"))
    squeezed = pages.select(*key, "page", bare(F.col("text")).alias("text"))
    probes = F.substring("b", OFFSET + 1, PROBE), F.substring(F.col("b"), F.greatest(F.length("b") - PROBE - OFFSET, F.lit(OFFSET)) + 1, F.lit(PROBE))
    whole = lambda x: F.when((F.length("b") >= LEAST) & (F.length(x) == PROBE), x)
    asked = rows.select(*own, "claimed", whole(probes[0]).alias("head"), whole(probes[1]).alias("tail"))

    def look(document: Pages, claimed: int | None, head: str | None, tail: str | None) -> tuple[int | None, int | None]:
        if claimed is None:
            return None, None
        first, last = (p and document.first(p, claimed, claimed + FORWARD) for p in (head, tail))
        start = next((p for p in (first, last) if p is not None), claimed)
        return start, max(start, next((p for p in (last, first) if p is not None), claimed))

    kind = pieces.unionByName(pages.select(F.col("page").alias("claimed")), allowMissingColumns=True).schema["claimed"].dataType
    return _looked_up(asked, squeezed, key, ["claimed", "head", "tail"], look).select(*own, F.col("page_start").cast(kind), F.col("page_end").cast(kind))


def repaired_sources(messages: DataFrame, pages: DataFrame, message: str) -> DataFrame:
    """``messages`` (message, sources) with the pages of each source looked up anew: sources are structs with doc_id, body,
    page_start and page_end. A source without document or page stays as it is; null and empty lists stay, too.
    ``pages``: (doc_id, page, text)."""
    each = messages.select(message, F.posexplode("sources").alias("piece_no", "s"))
    stale = each.where("s.doc_id IS NOT NULL AND s.page_start IS NOT NULL").select(message, "piece_no", "s.doc_id", "s.body", F.col("s.page_start").alias("claimed"))
    # a message's sources may be of several documents: pieces are named by both
    named = stale.select("doc_id", F.struct(message, "piece_no").alias("piece_no"), F.coalesce("body", F.lit("")).alias("body"), "claimed")
    found = located_pages(named, pages, ["doc_id"]).select(f"piece_no.{message}", "piece_no.piece_no", "page_start", "page_end")
    # what is found goes to the messages as one map each, so their texts aren't taken apart and put together again
    maps = found.groupBy(message).agg(F.map_from_entries(F.collect_list(F.struct("piece_no", F.struct("page_start", "page_end")))).alias("found"))

    def fixed(s: Column, i: Column) -> Column:
        new = F.try_element_at("found", i)
        return F.when(new.isNotNull(), s.withField("page_start", new["page_start"]).withField("page_end", new["page_end"])).otherwise(s)

    return messages.join(maps, message, "left").withColumn("sources", F.when(F.col("found").isNull(), F.col("sources")).otherwise(F.transform("sources", fixed))).drop("found")
