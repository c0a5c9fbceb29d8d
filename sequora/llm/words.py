"""Words of whole Arrow columns of text, as numpy arrays: bounds, and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By the number of bytes left: which of eight bytes are a word's.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def mixed(x: np.ndarray, by: np.uint64 = np.uint64(1)) -> np.ndarray:
    """mix(x * by) of whole numbers from 0 on, looked up where there are more of them than different ones."""
    top = int(x.max()) + 1 if len(x) else 0
    return mix(np.arange(top, dtype=np.uint64) * by)[x] if top < len(x) else mix(x.astype(np.uint64) * by)


def blocks(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, or of one row."""
    offsets = text_buffers(column)[1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, len(column))
        at = min(to, len(column))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows (text or binary) in a row, and where each row starts (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"", column.type) if "binary" in str(column.type) else "")
    kind = np.int64 if str(column.type).startswith("large") else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Maximal runs without ASCII white space. first[i]:first[i + 1] are the words of row i."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, self.offsets = text_buffers(column)
        self.data = _LOWER[data] if lower else data
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            edge[0], edge[-1] = solid[0], solid[-1]
            np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        self.starts, self.ends = at[::2], at[1::2]
        rows = np.unique(self.offsets[(self.offsets > 0) & (self.offsets < len(data))])
        rows = rows[solid[rows - 1] & solid[rows]]  # where a row's last word meets the next one's first
        if len(rows):
            self.starts = np.insert(self.starts, np.searchsorted(self.starts, rows), rows)
            self.ends = np.insert(self.ends, np.searchsorted(self.ends, rows), rows)
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, 8 bytes a round."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
        size = (self.ends - self.starts).astype(np.int64)
        out = mix((mixed(size, _C3) ^ (eight[self.starts] & _MASKS[np.minimum(size, 8)])) * _C3 + np.uint64(1))
        todo, k = np.flatnonzero(size > 8), 8
        while len(todo):
            part = eight[self.starts[todo] + k] & _MASKS[np.minimum(size[todo] - k, 8)]
            out[todo] = mix((out[todo] ^ part) * _C3 + np.uint64(k + 1))
            k += 8
            todo = todo[size[todo] > k]
        return out


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row and the row of each; a row of fewer words has one of all its words."""
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, np.minimum(count, 1)))
    base = np.repeat(first[:-1], np.maximum(count - n + 1, np.minimum(count, 1)))
    if not len(rows):
        return np.zeros(0, np.uint64), rows
    at = base + np.arange(len(rows)) - np.repeat(np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]), len(rows)]))
    end, size = first[rows + 1], np.minimum(count[rows], n)
    h = mix(size.astype(np.uint64))
    for k in range(n):
        more = at + k < end
        h = np.where(more, mix((h ^ words[np.minimum(at + k, len(words) - 1)]) * _C3), h)
    return h, rows
