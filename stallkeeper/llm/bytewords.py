"""Words of many texts at once, as numpy arrays over the bytes Arrow hands over."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_codes() -> np.ndarray:
    """A random word for each byte, A-Z with the words of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes[65:91] = codes[97:123]
    return codes


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = SEGMENT):
    """(first row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z in lower case, the first byte of each, and the index of each text's first word."""
    hashes, firsts, a = [], [], 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    codes = _byte_codes()
    while a < len(data):
        b = min(len(data), a + SEGMENT)
        while b < len(data) and not IS_SPACE[data[b]]:  # a segment ends at a space
            more = np.flatnonzero(IS_SPACE[data[b : b + SEGMENT]])
            b = min(len(data), b + (int(more[0]) if len(more) else SEGMENT))
        part, cut = data[a:b], edge[a : b + 1]
        inside = ~IS_SPACE[part]
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        start = np.flatnonzero(inside & (~before | cut[:-1]))
        end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        up, down = _powers(1 << max(16, int(len(part)).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[part] * up[: len(part)])])
        hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        firsts.append(start + a)
        a = b
    first = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), first, np.searchsorted(first, offsets)
