"""Document fingerprints from improbable features.

Every window of 64 bytes has an entropy, and a rarity rank that follows from it: windows far
from the usual entropy of text rank first, near-constant ones last.  In each run of 64
neighbouring windows the one of lowest rank (the leftmost of equals) wins a point; windows
with 16 points are the text's features.  A feature's hash sets five bits in a Bloom filter of
2,048 bits, which takes 160 features before the next one is chained to it.  The fingerprint is
the number of features and the filters.  Two fingerprints are compared filter by filter: common
bits, less what chance gives, over the most that could be common; each filter of the shorter
one takes its best partner, weighted by its features.

Entropies of all windows come from two counts per byte, how often it occurs in the window that
it opens and in the one that it closes, by 63 shifted comparisons and running sums.

Scale: ``fingerprinted`` shuffles nothing.  The query, which pairs each document with the next
one by id, moves each text once, by range of the id.

Edge cases: a text under 64 bytes has all its windows of 8 bytes as features (one feature if it
is shorter still); an empty or null text has none; two fingerprints without features are alike
(1.0), one with and one without are not (0.0); equal texts have equal fingerprints; in the query,
rows with the same id follow each other in any one order, null ids come last, and the only row of a table
is its own next; an empty table gives an empty result; repeated rows have equal fingerprints; a very
long text takes about 10 times its bytes in the query, and comparing two such ones the product of their sizes in time; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges, textbuf

WINDOW = 64
RUN = 64
POINTS = 16
BLOCK_BYTES = 1 << 18
FILTER_BITS = 2048
FILTER_FEATURES = 160
BITS_PER_FEATURE = 5
SHORT_WINDOW = 8
ROWS_PER_BUCKET = 4096
SMALL_TABLE = 500_000
PAD = 0xFF  # never part of UTF-8

_F = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))])
_STEP = np.concatenate([[0], np.round(np.diff(_F) * (1 << 16)).astype(np.int64)])  # f(c) - f(c - 1)
_FULL = int(_STEP.sum())


def _ranks() -> np.ndarray:
    """Rank of each entropy, in thousandths of the most that a window can have: text is usually near 700."""
    h = np.arange(1001)
    rank = np.round(1000 * np.exp(-(((h - 700) / 100) ** 2) / 2)).astype(np.int64)
    rank[h < 100] = 2000
    return rank


RANKS = _ranks()
_NONE = 1 << 20


class Filters:
    """The fingerprints of some texts: filter rows first[d] .. first[d + 1] - 1 belong to text d."""

    def __init__(self, features: np.ndarray, first: np.ndarray, bits: np.ndarray):
        self.features, self.first, self.bits = features, first, bits
        self.ones = np.bitwise_count(bits).sum(axis=1)
        self.filled = np.zeros(len(bits), np.int64)
        for d in np.flatnonzero(np.diff(first) > 0):
            n = int(first[d + 1] - first[d])
            self.filled[first[d] : first[d + 1]] = [FILTER_FEATURES] * (n - 1) + [int(features[d]) - FILTER_FEATURES * (n - 1)]

    def text(self, d: int) -> str:
        return f"{int(self.features[d])}:" + base64.b64encode(self.bits[self.first[d] : self.first[d + 1]].tobytes()).decode()


def parsed(fingerprints: list[str]) -> Filters:
    """The filters of fingerprint strings."""
    counts, blobs = [], []
    for f in fingerprints:
        n, _, blob = f.partition(":")
        counts.append(int(n))
        blobs.append(base64.b64decode(blob))
    first = np.concatenate([[0], np.cumsum([len(b) * 8 // FILTER_BITS for b in blobs])]).astype(np.int64)
    return Filters(np.array(counts, np.int64), first, np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, FILTER_BITS // 8))


def _selected(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start in data, text) of the features of the texts of at least 64 bytes, in order."""
    size = np.diff(offsets)
    big = np.flatnonzero(size >= WINDOW)
    if not len(big):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the texts, each with WINDOW pad bytes before it, so that no comparison meets two texts
    place = np.cumsum(size[big] + WINDOW) - size[big]
    total = int(place[-1] + size[big[-1]] + WINDOW)
    x = np.full(total, PAD, np.uint8)
    for d, p in zip(big.tolist(), place.tolist(), strict=True):
        x[p : p + size[d]] = data[offsets[d] : offsets[d + 1]]
    opens, closes = np.ones(total, np.uint8), np.ones(total, np.uint8)
    for lag in range(1, WINDOW):
        same = (x[:-lag] == x[lag:]).view(np.uint8)
        opens[:-lag] += same
        closes[lag:] += same
    real = x != PAD
    gain = np.zeros(total + 1, np.int64)
    np.cumsum(np.where(real, _STEP[closes], 0), out=gain[1:])
    loss = np.zeros(total + 1, np.int64)
    np.cumsum(np.where(real, _STEP[opens], 0), out=loss[1:])
    # valid windows start at place .. place + size - WINDOW
    valid = np.zeros(total + 1, np.int8)
    valid[place] = 1
    valid[place + size[big] - WINDOW + 1] = -1
    valid = np.cumsum(valid[:total], dtype=np.int8).astype(bool)
    key = np.full(total, _NONE << 32, np.int64)
    at = np.flatnonzero(valid)
    owner = np.repeat(np.arange(len(big)), size[big] - WINDOW + 1)
    # the sum of f over the window at i: gains up to its end, less losses before it, both within the text
    s = gain[at + WINDOW] - gain[place][owner] - (loss[at] - loss[place][owner])
    entropy = np.clip((_FULL - s) * 1000 // _FULL, 0, 1000)
    key[at] = (RANKS[entropy] << 32) | at
    best, width = key, 1
    while width < RUN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = best[best < (_NONE << 32)] & 0xFFFFFFFF
    cuts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    points = np.diff(np.append(cuts, len(best)))
    won = best[cuts[points >= POINTS]]
    which = np.searchsorted(place, won, "right") - 1
    return won - place[which] + offsets[big[which]], big[which]


PIECE_BYTES = 1 << 20
_HALO = WINDOW + 2 * RUN


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the features of the texts, in order.

    A text is looked at in pieces of ``PIECE_BYTES``: whether a window is a feature follows from the windows at
    most RUN away, so each piece is widened by that much and gives the features that begin inside it.
    """
    size = np.diff(offsets)
    hashes, owners = [], []
    if (size > PIECE_BYTES).any():
        for d in range(len(size)):
            text = data[offsets[d] : offsets[d + 1]]
            if len(text) <= PIECE_BYTES:
                h, _ = _features(text, np.array([0, len(text)]))
                hashes.append(h)
                owners.append(np.full(len(h), d))
                continue
            for lo in range(0, len(text), PIECE_BYTES):
                begin, end = max(0, lo - _HALO), min(len(text), lo + PIECE_BYTES + _HALO)
                if end - begin < WINDOW:
                    continue
                starts, _ = _selected(text[begin:end], np.array([0, end - begin]))
                starts = starts[(starts >= lo - begin) & (starts < lo + PIECE_BYTES - begin)]
                if len(starts):
                    hashes.append(textbuf.span_hash(text[begin:end], starts, starts + WINDOW))
                    owners.append(np.full(len(starts), d))
        return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    starts, owner = _selected(data, offsets)
    ends = starts + WINDOW
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    if len(short):
        windows = np.maximum(size[short] - SHORT_WINDOW + 1, 1)
        s = textbuf.ragged(offsets[short], windows)
        o = np.repeat(short, windows)
        starts, ends, owner = np.concatenate([starts, s]), np.concatenate([ends, np.minimum(s + SHORT_WINDOW, offsets[o + 1])]), np.concatenate([owner, o])
        order = np.argsort(owner, kind="stable")
        starts, ends, owner = starts[order], ends[order], owner[order]
    return (textbuf.span_hash(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), owner


def filters(data: np.ndarray, offsets: np.ndarray) -> Filters:
    """The fingerprints of the texts of a block."""
    n = len(offsets) - 1
    h, owner = _features(data, offsets)
    # the first of equal features of a text
    order = np.lexsort((np.arange(len(h)), h, owner))
    fresh = np.ones(len(h), bool)
    fresh[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    h, owner = h[fresh], owner[fresh]
    features = np.bincount(owner, minlength=n).astype(np.int64)
    number = -(-features // FILTER_FEATURES)
    first = np.concatenate([[0], np.cumsum(number)])
    nth = np.arange(len(h)) - (np.cumsum(features) - features)[owner]
    row = first[owner] + nth // FILTER_FEATURES
    bits = np.zeros((int(first[-1]), FILTER_BITS), bool)
    for k in range(BITS_PER_FEATURE):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return Filters(features, first, np.packbits(bits, axis=1, bitorder="little"))


PAIRS_AT_ONCE = 1 << 16


def likeness(a: Filters, i: int, b: Filters, j: int) -> float:
    """0 to 1: how much of the shorter fingerprint is found in the other.

    The filters are compared in chunks, so memory follows one fingerprint, not both multiplied; time is their product.
    """
    if not a.features[i] or not b.features[j]:
        return float(a.features[i] == b.features[j])
    if (b.first[j + 1] - b.first[j], b.features[j]) < (a.first[i + 1] - a.first[i], a.features[i]):
        a, i, b, j = b, j, a, i
    ra, rb = slice(a.first[i], a.first[i + 1]), slice(b.first[j], b.first[j + 1])
    x, y = a.bits[ra].view(np.uint64), b.bits[rb].view(np.uint64)
    p, q = a.ones[ra].astype(float), b.ones[rb].astype(float)
    score = np.zeros(len(x))
    wide = min(len(y), PAIRS_AT_ONCE)
    tall = max(1, PAIRS_AT_ONCE // wide)
    for lo in range(0, len(x), tall):
        for to in range(0, len(y), wide):
            common = np.zeros((len(x[lo : lo + tall]), len(y[to : to + wide])))
            for w in range(x.shape[1]):
                common += np.bitwise_count(x[lo : lo + tall, w, None] & y[None, to : to + wide, w])
            one, two = p[lo : lo + tall, None], q[None, to : to + wide]
            chance, most = one * two / FILTER_BITS, np.minimum(one, two)
            cut = chance + 0.3 * (most - chance)
            found = np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1).max(axis=1)
            np.maximum(score[lo : lo + tall], found, out=score[lo : lo + tall])
    weight = a.filled[ra]
    return float((score * weight).sum() / weight.sum())


def fingerprinted(documents: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with a fingerprint column (replaced if there is one)."""
    kept = [f for f in documents.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbuf.blocks(batches, text):
            found = filters(*textbuf.buffers(b.column(text)))
            yield pa.RecordBatch.from_pydict({**{f.name: b.column(f.name) for f in kept}, name: pa.array([found.text(d) for d in range(b.num_rows)], pa.string())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` string"])
    return textbuf.small_batches(documents).select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def compared(rows: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """The rows with the likeness of two fingerprint columns (null if either is null)."""

    @F.pandas_udf("double")
    def score(x, y):
        import pandas as pd

        ok = (x.notna() & y.notna()).to_numpy()
        fa, fb = parsed(x[ok].tolist()), parsed(y[ok].tolist())
        out = np.full(len(x), np.nan)
        out[ok] = [likeness(fa, i, fb, i) for i in range(int(ok.sum()))]
        return pd.Series(out).astype(object).where(ok, None)

    return rows.withColumn(name, score(a, b))


def edited(text: str, following: str) -> str:
    """The last third replaced by the beginning of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, ghosts last; a ghost is only the next of the row before it."""
    held: list[tuple] = []  # the row whose next is not known yet
    opening: tuple | None = None

    def made(rows: list[tuple], after: list[tuple | None]) -> pa.RecordBatch:
        """rows with their next rows."""
        n = len(rows)
        texts = [r[2] for r in rows]
        new = [edited(t, a[2]) for t, a in zip(texts, after, strict=True)]
        chain = all(after[i] is rows[i + 1] for i in range(n - 1))
        following = [after[-1][2]] if chain else [a[2] for a in after]
        raw = pa.array(texts + following + new, pa.large_string())
        f = filters(*textbuf.buffers(raw))
        m = len(texts) + len(following)
        nxt = (lambda i: i + 1) if chain else (lambda i: n + i)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([r[1] for r in rows], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                "fingerprint": pa.array([f.text(i) for i in range(n)], pa.string()),
                "edited_fingerprint": pa.array([f.text(m + i) for i in range(n)], pa.string()),
                "near_edited": pa.array([likeness(f, i, f, m + i) for i in range(n)], pa.float64()),
                "near_next": pa.array([likeness(f, i, f, nxt(i)) for i in range(n)], pa.float64()),
            }
        )

    for b in textbuf.blocks(batches, limit=BLOCK_BYTES):
        rows = list(zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), (t or "" for t in b.column("text").to_pylist()), b.column("ghost").to_pylist(), strict=True))
        out, after = [], []
        for r in rows:
            if held and held[0][0] != r[0]:  # a bucket without a ghost is the whole table
                out.append(held.pop())
                after.append(opening)
            if held:
                out.append(held.pop())
                after.append(r)
            elif not r[3]:
                opening = r
            if not r[3]:
                held.append(r)
            elif opening and opening[0] == r[0]:
                opening = (r[0], None, "", "spent")  # further ghosts of the bucket are skipped: nothing is held
        if out:
            yield made(out, after)
    if held:
        yield made(held, [opening])


def neighbours(documents: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows in range buckets of the id; each bucket also gets, as a ghost, the row that follows its last one.

    The order is by descending id (none comes last), then by a hash of the text, which also parts the rows of
    an id, or of none, that fill several buckets; the last row is followed by the first.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = ranges.bounds(docs, "doc_id", rows_per_bucket)
    # texts are only hashed, which takes another look at them, where ids have to be parted
    hashed = F.xxhash64("text") if ranges.by_hash(ends) else F.lit(0).cast("long")
    docs = docs.withColumn("place", hashed)
    where = ranges.bucket(F.col("doc_id"), F.col("place"), ends).cast("int")
    tops = docs.select(where.alias("bucket"), F.struct("doc_id", "place").alias("row")).groupBy("bucket").agg(F.max("row").alias("top"))
    # one row per bucket: the first row of a bucket follows the last row of the bucket above it
    order = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ghosts = tops.select("top", above.alias("bucket"))
    if len(ends) < SMALL_TABLE:
        ghosts = F.broadcast(ghosts)
    own = docs.select("doc_id", "text", "place", where.alias("bucket"), F.lit(False).alias("ghost"))
    extra = docs.join(ghosts, docs["doc_id"].eqNullSafe(F.col("top.doc_id")) & (docs["place"] == F.col("top.place"))).select("doc_id", "text", "place", "bucket", F.lit(True).alias("ghost"))
    rows = own.unionByName(extra).repartitionById(len(ends) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc("place"), "text")
    return rows.select("doc_id", "text", "bucket", "ghost")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return textbuf.small_batches(neighbours(docs)).mapInArrow(_report, schema)
