"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every benchmark item gives its windows of 13 consecutive normalised words (a shorter item
gives one window).  The windows' 64-bit hashes form a sorted set behind a bitmap; documents
are scanned once in Arrow batches, every candidate position is verified byte by byte against
the item's own words, and the words inside any occurrence are hit.  The set is flat arrays of
about 20 bytes a window, built a megabyte of text at a time.

Scale: the documents are never shuffled.  The benchmark is broadcast in blocks of at most
``BLOCK_BYTES`` text bytes, whose sizes are measured first; with several blocks the hits are
carried along from scan to scan of one plan, so each further block costs a task one more worker
process with that block's set.

Edge cases: a null or empty text has no words and is never contaminated; null or wordless
texts of items have no windows; items without an id are together one item, unnamed in the digest;
items that repeat (same id, or same text under another id) each count by id; an empty benchmark
hits nothing; an empty table of documents gives an empty result; repeated rows are judged one by
one; a very long text is a block of its own (about 13 times its bytes); extra columns of either
table are ignored by ``scan`` and passed through, whatever their names, by the other two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import textbuf

N = 13
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = 20


def normalised(text: str | None) -> list[bytes]:
    """The lower-cased words of a text."""
    return _WORD.findall((text or "").encode().translate(_UPPER))


BUILD_BYTES = 1 << 18
_GAP = 0x20


class Grams:
    """The windows of some benchmark items, by window length, in flat arrays.

    ``text`` holds the items' lower-cased words with one space between them, so that a window is a run of its bytes.
    Of each length there are, ordered by hash, the distinct windows of every item: hash, start and size in
    ``text``, and the item's number: 20 bytes a window besides the text.
    """

    def __init__(self, items: pa.Table, n: int = N):
        names: dict[str | None, int] = {}
        numbers = np.fromiter((names.setdefault(i, len(names)) for i in items.column("item").to_pylist()), np.int32, items.num_rows)
        self.names = list(names)
        kept: dict[int, list[tuple[np.ndarray, ...]]] = {}
        text, base, row = [], 0, 0
        for batch in items.combine_chunks().to_batches():
            for b in textbuf.blocks(iter([batch]), limit=BUILD_BYTES):
                data, offsets = textbuf.buffers(b.column("text"))
                starts, ends, doc, h = textbuf.words(data, offsets)
                size = ends - starts
                plain = np.full(int(size.sum()) + len(size), _GAP, np.uint8)
                place = np.cumsum(size + 1) - (size + 1)
                plain[textbuf.ragged(place, size)] = textbuf.LOWER[data[textbuf.ragged(starts, size)]]
                first = textbuf.per_doc(doc, len(offsets) - 1)
                words = np.diff(first)
                for k in np.unique(np.minimum(words, n)[words > 0]).tolist():
                    w = textbuf.window_hash(h, k)
                    at = np.arange(len(w))
                    at = at[(doc[at] == doc[at + k - 1]) & (np.minimum(words, n)[doc[at]] == k)]
                    part = (w[at], (place[at] + base).astype(np.int32 if items.nbytes < 1 << 30 else np.int64), (place[at + k - 1] + size[at + k - 1] - place[at]).astype(np.int32), numbers[row + doc[at]])
                    kept.setdefault(k, []).append(part)
                text.append(plain)
                base += len(plain)
                row += b.num_rows
        self.text = np.concatenate(text) if text else np.zeros(0, np.uint8)
        self.sets: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted(kept):
            columns = [np.concatenate(c) for c in zip(*kept.pop(k), strict=True)]
            order = np.lexsort((columns[3], columns[0]))
            columns = [c[order] for c in columns]
            fresh = np.ones(len(order), bool)  # a window that an item repeats is held once, unless hashes collide
            fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[3][1:] != columns[3][:-1]) | (columns[2][1:] != columns[2][:-1])
            self.sets[k] = tuple(c[fresh] for c in columns)

    def window(self, k: int, entry: int) -> bytes:
        start = int(self.sets[k][1][entry])
        return self.text[start : start + int(self.sets[k][2][entry])].tobytes()

    def bitmap(self, k: int) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(self.sets[k][0] & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        return bits


def scan_block(data: np.ndarray, offsets: np.ndarray, grams: Grams, bitmaps: dict[int, np.ndarray]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """(words, hit word ranges, items) of each document of a block."""
    n_docs = len(offsets) - 1
    starts, ends, doc, h = textbuf.words(data, offsets)
    first = textbuf.per_doc(doc, n_docs)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    found: list[set[str]] = [set() for _ in range(n_docs)]
    for k, (hashes, _, _, items) in grams.sets.items():
        w = textbuf.window_hash(h, k)
        if not len(w):
            continue
        at = np.flatnonzero(bitmaps[k][(w & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        at = at[doc[at] == doc[at + k - 1]]
        lo, hi = np.searchsorted(hashes, w[at]), np.searchsorted(hashes, w[at], "right")
        known = hi > lo
        for i, a, b in zip(at[known].tolist(), lo[known].tolist(), hi[known].tolist(), strict=True):
            own = b" ".join(_WORD.findall(data[starts[i] : ends[i + k - 1]].tobytes().translate(_UPPER)))
            true = [e for e in range(a, b) if grams.window(k, e) == own]
            if true:
                d = int(doc[i])
                j = i - int(first[d])
                spans[d].append((j, j + k))
                found[d].update(grams.names[items[e]] for e in true)
    return np.diff(first), spans, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SCAN_SCHEMA = "doc_id long, n_words long, hit_from array<int>, hit_to array<int>, items array<string>"


def _scanner(bc, carry: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Grams = bc.value
        bitmaps = {k: grams.bitmap(k) for k in grams.sets}
        for b in textbuf.blocks(batches):
            data, offsets = textbuf.buffers(b.column("text"))
            n_words, spans, found = scan_block(data, offsets, grams, bitmaps)
            if carry:
                for d, (a, e, i) in enumerate(zip(b.column("hit_from").to_pylist(), b.column("hit_to").to_pylist(), b.column("items").to_pylist(), strict=True)):
                    spans[d] += zip(a, e, strict=True)
                    found[d] |= set(i)
            spans = [merge(s) if s else s for s in spans]
            cols = [
                b.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32())),
                pa.array([[e for _, e in s] for s in spans], pa.list_(pa.int32())),
                pa.array([sorted(f, key=lambda i: (i is None, i or "")) for f in found], pa.list_(pa.string())),
            ]
            names = ["doc_id", "n_words", "hit_from", "hit_to", "items"]
            if keep_text:
                cols, names = [*cols, b.column("text")], [*names, "text"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The items in blocks of about ``limit`` bytes of text, measured before anything is collected."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield part.toArrow()


def _numbered(blocks):
    """(number, block, whether it is the last); one block is held at a time besides the next."""
    k, held = 0, next(blocks)
    for following in blocks:
        yield k, held, False
        k, held = k + 1, following
    yield k, held, True


def scan(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, limit: int = BLOCK_BYTES) -> DataFrame:
    """The words of each document that lie in benchmark windows, as merged word ranges, and the items hit."""
    df = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for k, items, last in _numbered(benchmark_blocks(benchmark, item_id, item_text, limit)):
        run = _scanner(spark.sparkContext.broadcast(Grams(items, n)), carry=k > 0, keep_text=not last)
        df = textbuf.small_batches(df).mapInArrow(run, SCAN_SCHEMA + ("" if last else ", text string"))
    return df


def report(hits: DataFrame) -> DataFrame:
    """Counts and the verdict: at least one word in twenty, and at least one, is hit."""
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return (
        hits.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort("items")), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    )


def _marked(spans: list[list[tuple[int, int]]], batch: pa.RecordBatch, name: str, carry: bool) -> tuple[list[list[tuple[int, int]]], pa.RecordBatch]:
    """The merged spans with those carried in a column (from, to, from, ...), and the batch without it."""
    if carry:
        for d, flat in enumerate(batch.column(name).to_pylist()):
            spans[d] += zip(flat[::2], flat[1::2], strict=True)
        batch = batch.drop_columns([name])
    return [merge(s) if s else s for s in spans], batch


def _over_rows(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, finish, n: int, limit: int) -> DataFrame:
    """Whole rows through one scan a benchmark block; ``finish`` (batch, words, hit word ranges) -> batch is the last one's.

    Between the scans the rows carry their hits in a column whose name no other has.
    """
    schema, name = documents.schema, textbuf.unused("_hits", documents)
    wide = StructType([*schema.fields, StructField(name, ArrayType(IntegerType()))])

    def scanner(bc, carry: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams: Grams = bc.value
            bitmaps = {k: grams.bitmap(k) for k in grams.sets}
            for b in textbuf.blocks(batches):
                n_words, spans, _ = scan_block(*textbuf.buffers(b.column("text")), grams, bitmaps)
                spans, b = _marked(spans, b, name, carry)
                yield finish(b, n_words, spans) if last else b.append_column(name, pa.array([[x for s in q for x in s] for q in spans], pa.list_(pa.int32())))

        return run

    df = textbuf.small_batches(documents)
    for k, items, last in _numbered(benchmark_blocks(benchmark, "item_id", "text", limit)):
        df = df.mapInArrow(scanner(spark.sparkContext.broadcast(Grams(items, n)), k > 0, last), schema if last else wide)
    return df


def _cut(b: pa.RecordBatch, _, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    if not any(spans):
        return b
    texts = b.column("text").to_pylist()
    for d in [d for d, q in enumerate(spans) if q]:
        raw = texts[d].encode()
        at = [m.span() for m in _WORD.finditer(raw.translate(_UPPER))]
        cuts = [0, *(x for i, j in spans[d] for x in (at[i][0], at[j - 1][1])), len(raw)]
        texts[d] = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode()
    i = b.schema.get_field_index("text")
    return b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))


def _clean(b: pa.RecordBatch, n_words: np.ndarray, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    n_hit = [sum(e - a for a, e in s) for s in spans]
    return b.filter(pa.array([not (hit > 0 and 20 * hit >= n) for hit, n in zip(n_hit, n_words.tolist(), strict=True)], pa.bool_()))


def remove_spans(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, n: int = N, limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every hit run of words, and the separators inside it, cut out of the text; all else stays."""
    return _over_rows(spark, documents, benchmark, _cut, n, limit)


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, n: int = N, limit: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the contaminated ones; all columns stay.  Every row is judged by its own text."""
    return _over_rows(spark, documents, benchmark, _clean, n, limit)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(scan(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: The same rows in DuckDB: windows as joined word strings.
OP5_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as (
  select distinct item_id, least(13, len(ws)) as k, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') as g
  from b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as u(i) where len(ws) > 0
), ks as (select distinct k from bw),
dw as (
  select doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') as g
  from w, ks, unnest(range(1, len(ws) - k + 2)) as u(i) where len(ws) >= k
), hit as (select doc_id, dw.k, i, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
words as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, k, i from hit), unnest(range(i, i + k)) as v(p) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join words using (doc_id) left join items using (doc_id)
"""
