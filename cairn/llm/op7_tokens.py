"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (``safe_cuts``), where the byte-level pre-tokeniser always
parts two tokens whatever stands around, so the counts of the parts add up to the count of the
whole.  Parts of many texts are encoded together in batches of about equal bytes, and only
their lengths are kept.  No text is truncated or padded and nothing is shuffled.

Edge cases: null and empty texts have no tokens; special strings inside a text are handled as
the library does by default; a text without any safe boundary is encoded in one part; repeated rows
count alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf, units

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
PART_BYTES = 1 << 14
BATCH_BYTES = 1 << 19

_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0D, 0x20]] = True
#: Visible ASCII; a two-byte character from U+00C0 to U+00FF counts too (``safe_cuts``).
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, one per process, without truncation and padding."""
    if path not in _loaded:
        units.threaded()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions just before a single white-space byte between two visible characters of one text.

    There the pre-tokeniser's pattern ends one token and starts the next: no token holds a
    white-space character behind a visible one, and it never looks back.
    """
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(_WHITE[data[1:-1]]) + 1
    before = _VISIBLE[data[at - 1]] | ((at >= 2) & (data[np.maximum(at - 2, 0)] == 0xC3) & (data[at - 1] >= 0x80))
    after = _VISIBLE[data[at + 1]] | (data[at + 1] == 0xC3)
    at = at[before & after]
    doc = np.searchsorted(offsets, at, "right") - 1
    return at[(at > offsets[doc]) & (at + 1 < offsets[doc + 1])]


def parts(data: np.ndarray, offsets: np.ndarray, size: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, document) of parts of at most about ``size`` bytes, cut at safe boundaries only."""
    cuts = [offsets]
    long = np.flatnonzero(np.diff(offsets) > size)
    if len(long):
        safe = safe_cuts(data, offsets)
        for d in long:
            lo, hi = np.searchsorted(safe, [offsets[d] + 1, offsets[d + 1]])
            mine = safe[lo:hi]
            if len(mine):
                step = (mine - offsets[d]) // size
                cuts.append(mine[np.flatnonzero(np.diff(step)) + 1])
    bounds = np.sort(np.concatenate(cuts), kind="stable") if len(cuts) > 1 else offsets
    doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
    # empty texts share a boundary with their neighbour: keep one (empty) part for none of them
    real = bounds[1:] > bounds[:-1]
    return np.column_stack([bounds[:-1][real], bounds[1:][real]]), doc[real]


def count_tokens(tokenizer, texts: pa.Array) -> np.ndarray:
    """The token count of each text."""
    data, offsets = textbuf.buffers(texts)
    bounds, doc = parts(data, offsets)
    raw = data.tobytes()
    counts = np.zeros(len(bounds), np.int64)
    lo, n = 0, len(bounds)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds[:, 1], bounds[lo, 0] + BATCH_BYTES, "right")))
        batch = [raw[a:b].decode() for a, b in bounds[lo:hi]]
        counts[lo:hi] = [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        lo = hi
    return np.bincount(doc, counts, len(texts)).astype(np.int64)


def counted(documents: DataFrame, path: str | None = None, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count is over the limit."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in textbuf.blocks(batches):
            _, offsets = textbuf.buffers(b.column("text"))
            tokens = count_tokens(tokenizer, b.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    return textbuf.small_batches(documents).select(F.col("doc_id"), "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
