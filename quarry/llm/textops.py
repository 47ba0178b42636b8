"""Byte-level text kernels over Arrow string buffers.

Everything here works on whole Arrow batches with numpy: a batch's texts are one byte array and a list of
offsets, words and lines are index ranges in it, and a hash is one uint64 per word, line or window. No Python
object is made per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Largest number of text bytes in a chunk; a longer single text is a chunk by itself.
CHUNK_BYTES = 4 << 20
#: Bytes of text hashed at once.
_HASH_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD6E8FEB86659FD93

#: Words between the white space bytes 0x20 and 0x09-0x0D.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, letters and all bytes of non-ASCII characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Every byte but the line feed.
LINE_BYTES = np.ones(256, bool)
LINE_BYTES[0x0A] = False
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another independent-looking hash of the same values."""
    return mix(x + U64((salt * _ODD) & 0xFFFFFFFFFFFFFFFF))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's begin (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, where, held = column.buffers()
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers are used again by later tasks and would otherwise keep their largest size."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with at most `limit` bytes of text (or one row)."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of the integer columns `names`, which the batches are sorted by; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(x), np.int64) for x in names], 1)
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        for a, b in zip(begin, [*begin[1:], len(key)], strict=True):
            if held and last != tuple(key[a]):
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(key[a])
    if held:
        yield held
    give_back()


class Units:
    """Words or lines of a batch: byte ranges, their row, and each row's first unit."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        held = inside[data]
        first = held.copy()
        last = held.copy()
        if n:
            first[1:] &= ~held[:-1]
            last[:-1] &= ~held[1:]
            begins = offsets[:-1][offsets[:-1] < n]
            first[begins] |= held[begins]
            ends = offsets[1:][offsets[1:] > 0] - 1
            last[ends] |= held[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.data, self.rows = data, rows
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.count)])

    def __len__(self) -> int:
        return len(self.start)

    def keep(self, chosen: np.ndarray) -> None:
        """Only the chosen units stay."""
        self.start, self.end, self.row = self.start[chosen], self.end[chosen], self.row[chosen]
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """One uint64 per unit: a multilinear hash of its bytes, mixed with its length. fold: a byte map applied first.

        Eight bytes are needed for each byte of text, so long texts are hashed a stretch of units at a time.
        """
        out = np.zeros(len(self.start), U64)
        size = self.end - self.start
        edge = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + _HASH_BYTES, side="right")) - 1)
            own, first = size[at:to], edge[at:to] - edge[at]
            place = np.arange(edge[to] - edge[at]) - np.repeat(first, own)
            held = self.data[place + np.repeat(self.start[at:to], own)]
            if fold is not None:
                held = fold[held]
            value = (held.astype(U64) + U64(1)) * _coefficients(int(own.max()))[place]
            out[at:to] = mix(np.add.reduceat(value, first) + own.astype(U64) * U64(_ODD))
            at = to
        return out


def trimmed_lines(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Lines without the ASCII white space at their ends; lines of nothing else are left out."""
    lines = Units(data, offsets, LINE_BYTES)
    solid = np.flatnonzero(SPACE_WORDS[data])
    a = np.searchsorted(solid, lines.start)
    b = np.searchsorted(solid, lines.end)
    lines.keep(b > a)
    a, b = a[b > a], b[b > a]
    if len(lines):
        lines.start, lines.end = solid[a], solid[b - 1] + 1
    return lines


_held: dict[str, np.ndarray] = {}


def _coefficients(n: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers, one per byte of a unit."""
    if len(_held.get("c", ())) < n:
        _held["c"] = mix(np.arange(1, max(64, 2 * n) + 1, dtype=U64) * U64(_ODD)) | U64(1)
    return _held["c"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the window base and of its inverse modulo 2**64."""
    if len(_held.get("p", ())) < n:
        m = max(1 << 16, 2 * n)
        inverse = pow(_WINDOW_BASE, -1, 1 << 64)
        for name, base in (("p", _WINDOW_BASE), ("q", inverse)):
            steps = np.full(m, base, U64)
            steps[0] = 1
            _held[name] = np.multiply.accumulate(steps)
    return _held["p"][:n], _held["q"][:n]


def windows(hashes: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of each run of `width` units inside one row, and the index of its first unit."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, inverse = _powers(n)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * power, dtype=U64)])
    rolled = (total[width:] - total[:-width]) * inverse[: n - width + 1]
    inside = np.zeros(n + 1, np.int64)
    long = base[1:] - base[:-1] >= width
    np.add.at(inside, base[:-1][long], 1)
    np.add.at(inside, base[1:][long] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: n - width + 1]) > 0)
    return mix(rolled[at]), at


def planes(x: np.ndarray) -> bytes:
    """An integer array as byte planes: high bytes, mostly equal, lie together and compress to almost nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def deltas(x: np.ndarray, kind: type) -> bytes:
    return planes(np.diff(x, prepend=x.dtype.type(0)).astype(kind))


def undeltas(b: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unplanes(b, kind).astype(np.int64))


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true entries."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
