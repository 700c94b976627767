"""Encoding by distinct units.

A text is cut where its tokenizer always parts two tokens, so that its ids are the ids of its
units in order.  The distinct units of a block are encoded once (``dictionary_encode`` finds
them exactly, by their bytes) and a bounded cache keeps them for the following blocks.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import textbuf

CACHE_UNITS = 250_000
LONG_UNIT = 256
JOINED_UNITS = 1024
THREADS = 2
PIECE_BYTES = 1 << 22
LOOK = 1 << 16  # how far the end of a piece is looked for at once


def threaded() -> None:
    """Let the tokenizers library of this process spread a batch over ``THREADS`` threads, unless the environment
    says otherwise; to be called before its first use.  An executor runs one process a core, so more would only wait."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))


class UnitEncoder:
    """``encode``: units -> (all their ids, ids of each).  ``cuts``: (bytes, offsets) -> cut positions."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = CACHE_UNITS):
        self.encode, self.cuts, self.limit = encode, cuts, limit
        self.known: dict[bytes, int] = {}
        self.first = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _place(self, units: list[bytes]) -> int:
        """Encode units behind the known ones; the number of the first.  They become known while there is room."""
        flat, sizes = self.encode(units)
        n, m = len(self.known), len(self.known) + len(units)
        if m > len(self.first):
            self.first, self.length = (np.concatenate([a, np.zeros(max(len(a), m - len(a)), np.int64)]) for a in (self.first, self.length))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        ends = self.used + np.cumsum(sizes)
        self.first[n:m] = ends - sizes
        self.length[n:m] = sizes
        self.ids[self.used : self.used + len(flat)] = flat
        new = [u for u in units[: max(0, self.limit - n)] if len(u) <= LONG_UNIT]  # the long ones are last
        if new:
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            self.used = int(ends[len(new) - 1])
        return n

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each text) of a block."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        if len(data) > PIECE_BYTES + LOOK:
            return self._in_pieces(data, offsets)
        bounds = np.sort(np.concatenate([offsets, self.cuts(data, offsets)]), kind="stable")
        bounds = bounds[np.concatenate([[True], bounds[1:] != bounds[:-1]])]
        array = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        units = coded.dictionary.to_pylist()
        get = self.known.get
        number = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            fresh = fresh[np.argsort([len(units[i]) > LONG_UNIT for i in fresh], kind="stable")]
            number[fresh] = self._place([units[i] for i in fresh]) + np.arange(len(fresh))
        number = number[coded.indices.to_numpy()]
        length = self.length[number]
        ids = self.ids[textbuf.ragged(self.first[number], length)]
        ends = np.concatenate([[0], np.cumsum(length)])
        at = ends[np.searchsorted(bounds, offsets)]
        return ids, np.diff(at)


    def _in_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``run``, in pieces that end at text boundaries or cuts, so that memory follows the ids."""
        ids, sizes, lo = [], np.zeros(len(offsets) - 1, np.int64), 0
        while lo < len(data):
            hi = self._end(data, offsets, lo)
            d0, d1 = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi))
            part = data[lo:hi]
            got, n = self.run(part, np.clip(offsets[d0 : d1 + 1], lo, hi) - lo) if len(part) <= PIECE_BYTES + LOOK else self._whole(part)
            ids.append(got)
            sizes[d0 : d0 + len(n)] += n
            lo = hi
        return np.concatenate(ids), sizes

    def _end(self, data: np.ndarray, offsets: np.ndarray, lo: int) -> int:
        """Where the piece from ``lo`` on ends: about PIECE_BYTES further, or where a stretch that cannot be cut begins or ends."""
        at = lo + PIECE_BYTES
        hi = self._next(data, offsets, at)
        if hi - at <= LOOK:
            return hi
        before = offsets[(offsets > lo) & (offsets <= at)]
        some = self.cuts(data[lo:at], np.array([0, at - lo])) + lo
        before = np.concatenate([before, some[some > lo]])
        return int(before.max()) if len(before) else hi

    def _next(self, data: np.ndarray, offsets: np.ndarray, at: int) -> int:
        while at < len(data):
            ends = offsets[(offsets >= at) & (offsets < at + LOOK)]
            window = data[at - 4 : at + LOOK]
            some = self.cuts(window, np.array([0, len(window)])) + at - 4
            found = np.concatenate([ends, some[some >= at]])
            if len(found):
                return int(found.min())
            at += LOOK - 8
        return len(data)

    def _whole(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A stretch of one text without a place to cut is one unit."""
        return self.encode([part.tobytes()])


def one_by_one(tokenizer, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encode each unit as a text of its own."""
    got = [e.ids for e in tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    return (np.concatenate([np.array(g, np.uint32) for g in got]) if len(got) else np.zeros(0, np.uint32)), sizes


def joined(tokenizer, starts: np.ndarray, units: list[bytes], simple: Callable[[bytes], bool]) -> tuple[np.ndarray, np.ndarray]:
    """Encode many units as one text.

    ``simple`` units may be joined without changing their ids, and exactly their first id is
    one of ``starts`` (a flag for each id); the others are encoded one by one.
    """
    easy = np.fromiter(map(simple, units), bool, len(units))
    plain = np.flatnonzero(easy)
    texts = [b"".join([units[i] for i in plain[lo : lo + JOINED_UNITS]]).decode() for lo in range(0, len(plain), JOINED_UNITS)]
    got = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    flat = np.concatenate(got) if got else np.zeros(0, np.uint32)
    at = np.flatnonzero(starts[flat])
    if len(at) != len(plain):
        raise ValueError("units do not begin where their ids do")
    sizes = np.zeros(len(units), np.int64)
    sizes[plain] = np.diff(np.append(at, len(flat)))
    if easy.all():
        return flat, sizes
    hard = np.flatnonzero(~easy)
    other, other_sizes = one_by_one(tokenizer, [units[i] for i in hard])
    sizes[hard] = other_sizes
    first = np.zeros(len(units), np.int64)
    first[plain] = at
    first[hard] = len(flat) + np.cumsum(other_sizes) - other_sizes
    return np.concatenate([flat, other])[textbuf.ragged(first, sizes)], sizes
