"""The split of text before byte-pair merges, as numpy work on whole blocks.

The rule is the public pattern of the rank files: contractions, then letters, numbers or other signs with one blank
before them, then blanks. Every character belongs to exactly one piece, so that pieces are offsets into the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_CLASSES: np.ndarray | None = None
#: What the pattern accepts after an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def classes() -> np.ndarray:
    """Class of each code point, by asking the pattern engine about every code point once."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = 0
        text = points.tobytes().decode("utf-32-le")
        kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for found in regex.finditer(pattern, text):
                kinds[found.start() : found.end()] = kind
        _CLASSES = kinds
    return _CLASSES


def piece_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pieces among the code points of a block; no piece crosses the start of a text.

    ``doc_starts``: where texts begin; equal entries are empty texts.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[doc_starts] = True
    begins[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change | begins[:n]
    space = kind == SPACE
    # blanks before a text's next sign: the last of them is a piece of its own, or joins that sign if it is " "
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~joined
    # contractions: an apostrophe that begins a piece
    marks = np.nonzero((points == 39) & start)[0]
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        ends = np.nonzero(begins)[0]
        room = ends[np.searchsorted(ends, marks, side="right")] - marks
        one = np.isin(padded[marks + 1], [ord(c) for c in SHORT]) & (room >= 2)
        two = np.zeros(len(marks), bool)
        for pair in LONG:
            two |= (padded[marks + 1] == ord(pair[0])) & (padded[marks + 2] == ord(pair[1]))
        two &= room >= 3
        for chosen, size in ((one & ~two, 2), (two & ~one, 3)):
            at = marks[chosen]
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    return np.nonzero(start)[0]


def pieces(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All pieces of a block of texts, dictionary-encoded, and the number of pieces of each text."""
    from millrace.llm.common import text_bytes

    data, offsets = text_bytes(column)
    lead = (data & 0xC0) != 0x80
    text = data.tobytes().decode("utf-8", "surrogatepass")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at_byte = np.append(np.nonzero(lead)[0], len(data))
    doc_starts = np.searchsorted(at_byte, offsets)
    starts = piece_starts(points, doc_starts[:-1])
    edges = np.append(at_byte[starts], len(data)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes()))
    counts = np.diff(np.searchsorted(starts, doc_starts))
    return flat.dictionary_encode(), counts
