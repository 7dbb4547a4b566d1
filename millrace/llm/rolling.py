"""Hashes of all byte windows of one width, computed with numpy by doubling."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def _byte_table() -> np.ndarray:
    """256 odd-looking 64-bit values by the splitmix64 rule."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)
    return mixed(state)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BYTE_VALUES = _byte_table()


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(BASE, exponent, _WORD))


def combine(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the polynomial of values[i : i + width]; the result has len(values) - width + 1 entries."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    current, size, total, have = values, 1, None, 0
    while True:
        if width & size:
            if total is None:
                total, have = current, size
            else:
                n = len(current) - have
                total = total[:n] + power(have) * current[have:]
                have += size
        if size * 2 > width:
            return total[: len(values) - width + 1]
        current = current[:-size] + power(size) * current[size:]
        size *= 2


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window data[i : i + width] of a byte array."""
    return mixed(combine(BYTE_VALUES[data], width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    current, size = values, 1
    while size * 2 <= width:
        current = np.minimum(current[:-size], current[size:])
        size *= 2
    rest = width - size
    return current if not rest else np.minimum(current[: len(current) - rest], current[rest:])
