"""Text columns as flat byte buffers, so that whole batches are handled by numpy.

A *block* is a slice of an Arrow batch with a bounded number of text bytes (a longer single
text makes a block of its own, so memory follows the longest text).  All hashes are taken
modulo 2**64 from prefix sums of ``byte * R**i``, which gives every word of a block its
hash without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 22

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
KEPT = 1 << 22
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: byte -> lower-case byte of a word character, 0 for a separator.
LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    LOWER[_b] = _b + 32


ROWS_PER_BATCH = 1000


def small_batches(df):
    """The rows, for a function over Arrow batches of few rows: texts are long, and the default of 10,000 rows
    costs an executor tens of MB several times over.  A session's own setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(ROWS_PER_BATCH))
    return df


def unused(name: str, df) -> str:
    """The name, lengthened until no column of the table has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = buffers(batch.column(column))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, min(hi, n) - lo)
            lo = min(hi, n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty.  offsets[0] is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if large else np.int32, n + 1, column.offset * (8 if large else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n.  Tables up to ``KEPT`` entries are kept."""
    for size, kept in _powers.items():
        if size >= n:
            return kept
    size = -(-max(1, n) // (1 << 16)) << 16
    out = []
    for r in (_R, _R_INV):
        p = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: R**(done + i) = R**done * R**i
            more = min(done, size - done)
            p[done : done + more] = p[:more] * np.uint64(pow(r, done, 1 << 64))
            done *= 2
        out.append(p)
    if size <= KEPT:
        for smaller in [k for k in _powers if k < size]:
            del _powers[smaller]
        _powers[size] = (out[0], out[1])
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, hash) of each lower-cased word; words never cross documents.

    A word is a maximal run of digits, ASCII letters and non-ASCII characters.  Much text is looked at in pieces
    that end at separators, so that memory follows the words and not 64-bit numbers for every byte.
    """
    if len(data) <= PIECE_BYTES:
        return _words(data, offsets)
    found, lo = [], 0
    while lo < len(data):
        hi = _separator(data, min(lo + PIECE_BYTES, len(data)))
        d0, d1 = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi))
        starts, ends, doc, h = _words(data[lo:hi], np.clip(offsets[d0 : d1 + 1], lo, hi) - lo)
        found.append((starts + lo, ends + lo, doc + d0, h))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _separator(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that holds a separator, or the end."""
    while at < len(data):
        some = np.flatnonzero(LOWER[data[at : at + (1 << 16)]] == 0)
        if len(some):
            return at + int(some[0])
        at += 1 << 16
    return len(data)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, doc, span_hash(low, starts, ends)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (length len(h) - n + 1, or 0)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a sorted document index: rows of document d are out[d]:out[d + 1]."""
    return np.searchsorted(doc, np.arange(n + 1))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length - 1 of each row, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
