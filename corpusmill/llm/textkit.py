"""Vectorised text primitives over Arrow string buffers.

Documents stay in the Arrow buffer they arrive in: words are found, hashed and
combined into n-grams for a whole block of documents at once with numpy, without a
Python object for any word. Hashes are 64-bit and wrap on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is handled alone.
BLOCK = 2 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C55)
_GAMMA = U(0x9E3779B97F4A7C15)

#: Byte classes: words between ASCII white space, and words of digits, a-z and non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
LETTERED = np.zeros(256, bool)
LETTERED[0x30:0x3A] = True
LETTERED[0x61:0x7B] = True
LETTERED[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x + _GAMMA
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    got = _powers.get(key)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, U(base), np.uint64)
        got[0] = U(1)
        with np.errstate(over="ignore"):
            got = np.cumprod(got, dtype=np.uint64)
        if size <= 2 * BLOCK:
            _powers[key] = got
    return got


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return buf, off - (off[0] if len(off) else 0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most BLOCK bytes of text each, or one document, with their buffers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if lower:
            column = pc.utf8_lower(column)
        buf, off = string_buffers(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


class Words:
    """The words of a block: byte spans, hashes, and each document's range of words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        inside = table[buf]
        first = inside.copy()
        last = inside.copy()
        if len(buf):
            np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
            np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
            heads = off[:-1][off[:-1] < off[1:]]
            first[heads] = inside[heads]
            tails = off[1:][off[:-1] < off[1:]] - 1
            last[tails] = inside[tails]
        self.buf = buf
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans: a polynomial over the bytes, moved to the origin, then mixed."""
        n = len(self.buf) + 1
        with np.errstate(over="ignore"):
            if self._prefix is None:
                self._prefix = np.zeros(n, np.uint64)
                np.cumsum(_BYTE[self.buf] * _power(int(_BASE), n, "up")[: n - 1], out=self._prefix[1:])
            h = (self._prefix[end] - self._prefix[start]) * _power(_INVERSE, n, "down")[start]
            return mix(h + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def position(self) -> np.ndarray:
        """Each word's place in its document."""
        return np.arange(len(self.start)) - np.repeat(self.off[:-1], self.count)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for every place where n words are left."""
    size = max(0, len(h) - n + 1)
    g = np.full(size, U(n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            g = mix(g * _BASE + h[i : i + size])
    return g


def word_hash(word: str) -> int:
    """The hash that Words gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)]), np.ones(256, bool)).hashes()[0])


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
