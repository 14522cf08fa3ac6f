"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a maximal run of bytes other than space and 0x09-0x0D. Since those are ASCII,
this is ``[^\\x20\\x09-\\x0D]+`` over the characters too. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_PIECE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Lower case, and ASCII marks as blanks: words are then runs of letters and digits.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32

# Code points of scripts written without blanks (Thai, Lao, Myanmar, Khmer, kana, Han, further Han): first, last.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF),
            (0x20000, 0x3FFFF)]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (mod 2**64), at least ``n`` of each."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if size > 1 << 21:  # for a very long word or text; not kept
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``values[start:end]`` (uint64 values), by one running sum."""
    up, down = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + length * np.uint64(0xA0761D6478BD642F))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and the ends of its texts (with a leading 0)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of, and the byte behind, every character in ``UNSPACED``."""
    at = np.flatnonzero(data >= 0xE0)
    wide = data[at] >= 0xF0
    part = [data[np.minimum(at + k, len(data) - 1)].astype(np.uint32) & 0x3F for k in range(4)]
    three = (data[at].astype(np.uint32) & 0x0F) << 12 | part[1] << 6 | part[2]
    code = np.where(wide, (data[at].astype(np.uint32) & 0x07) << 18 | part[1] << 12 | part[2] << 6 | part[3], three)
    ours = np.zeros(len(at), bool)
    for low, high in UNSPACED:
        ours |= (code >= low) & (code <= high)
    return at[ours], at[ours] + np.where(wide[ours], 4, 3)


class Words:
    """Words of a chunk of texts: ``start`` and ``end`` bytes of each, ``first[i]:first[i+1]`` those of text i."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None, unspaced: bool = False):
        """``table`` maps every byte beforehand (``LOWER``, ``PLAIN``); with ``unspaced`` every character of a
        script written without blanks is a word."""
        self.data, self.offsets = text_bytes(column)
        if table is not None:
            self.data = table[self.data]
        solid = ~_SPACE[self.data]
        n = len(solid)
        opens, closes = solid.copy(), solid.copy()
        if n:
            opens[1:] &= ~solid[:-1]
            closes[:-1] &= ~solid[1:]
            inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            opens[inner] |= solid[inner]
            closes[inner - 1] |= solid[inner - 1]
        if unspaced:
            at, after = _unspaced(self.data)
            opens[at], closes[after - 1] = True, True
            closes[np.maximum(at - 1, 0)] |= solid[np.maximum(at - 1, 0)] & (at > 0)
            behind = after[after < n]
            opens[behind] |= solid[behind]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + _PIECE_BYTES, "right")))
            piece = _BYTE[self.data[base:self.end[j - 1]]]
            out[i:j] = ranges_hash(piece, self.start[i:j] - base, self.end[i:j] - base)
            i = j
        return out

    def text_of(self) -> np.ndarray:
        """Index of the text each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def left(self) -> np.ndarray:
        """Words of the same text from each word on."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (those that run past a text are to be left out)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    starts = np.arange(n - size + 1)
    out = np.empty(len(starts), np.uint64)
    step = _PIECE_BYTES
    for a in range(0, len(starts), step):
        s = starts[a:a + step] - a
        out[a:a + step] = ranges_hash(hashes[a:a + step + size], s, s + size)
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            last = min(last, row + 20_000)
            yield batch.slice(row, last - row)
            row = last


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from the flat values and the length of each list."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
