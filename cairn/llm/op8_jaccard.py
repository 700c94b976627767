"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of ``K``-word shingles of lower-cased words (a text of fewer words is one
shingle).  Two texts are linked if the Jaccard similarity of their sets reaches 0.8.

1. One pass over the texts makes, per document, a 128-bit key of its word sequence, 160
   MinHash values (kept as bytes) and 32 band keys of five values each.
2. Equal word sequences form one class; everything below runs on classes.
3. Classes that share a band key meet in buckets.  Buckets with the same members are kept
   once, large ones are split into blocks.  In a bucket, MinHash values are compared in
   steps of 16; a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls below ``TOLERANCE``.  A bucket emits a spanning forest of
   the surviving pairs, never the pairs; in a large one a class is compared only with those that
   nothing ties to it yet, so near copies of each other cost little more than one look at each.
4. The forests' connected components hold every pair that may be linked.  Each component is
   dealt out as pairs of blocks, evenly over the partitions; in each, pairs are pruned again and
   the rest are verified on their exact shingle sets.  What leaves is, per class, the number of
   links and its root: again no pairs.  Texts outside the candidates do not move: they are left
   out by the scan, by a join with the candidates where those are few, else by bitmaps of at most 64 MB.
5. The components of the verified links are the near-duplicate classes.

A pair at exactly the threshold shares no band with probability 3e-6, less above it.  As every
class gets its number of links, step 4 is quadratic in the different texts of one group of near
copies (m**2 / 2 comparisons; each text is sent to m / 256 tasks up to 16,384 texts, then to 64, and
beyond 131,072 to m / 2,048).  Classes are joined by the first 64 bits of their key.

Edge cases: texts without words (null, empty, signs only) are classes of their own without
links; copies link to each other (J = 1) and count; repeated rows count as copies; an empty
table gives an empty result; a very long text is a block of its own (about 15 times its bytes); extra
columns are ignored by ``classes`` and stay, whatever their names, in ``deduplicated``.  A row is known by its id and text (two
64-bit hashes of both), so rows that share an id, or have none, are linked and removed by
their own texts; a class without any id has a null ``class_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans import storage
from . import textbuf

K = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
BLOCK_WORDS = 400_000
SMALL_TABLE = 500_000  # ids that may be broadcast: 8 MB
LARGE_GROUP = 64  # classes of a bucket beyond which they are not compared all with all
MOST_BITS = 29  # of the bitmaps: 64 MB


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their documents in order, words of each document, two 64-bit keys of its word sequence)."""
    n = len(offsets) - 1
    _, _, doc, h = textbuf.words(data, offsets)
    first = textbuf.per_doc(doc, n)
    n_words = np.diff(first)
    w = textbuf.window_hash(h, k)
    keep = np.flatnonzero(doc[: len(w)] == doc[k - 1 :][: len(w)]) if len(w) else np.zeros(0, np.int64)
    out, owner = w[keep], doc[keep]
    for size in range(1, k):
        short = np.flatnonzero(n_words == size)
        if len(short):
            at = first[short]
            out = np.concatenate([out, textbuf.window_hash(h, size)[at]])
            owner = np.concatenate([owner, short])
    if len(out) > len(keep):
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    keys = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        up, down = textbuf.powers(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(textbuf.mix(h ^ np.uint64(salt)) * up[: len(h)], out=sums[1:])
        keys.append(textbuf.mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + n_words.astype(np.uint64)))
    return out, owner, n_words, keys[0], keys[1]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = textbuf.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    c = (x >> np.uint64(32)).astype(np.uint32)
    return c[:HASHES] | np.uint32(1), c[HASHES:]


def minhash(sh: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The HASHES MinHash values of each document; rows without shingles stay 0."""
    sig = np.zeros((n, HASHES), np.uint32)
    if not len(sh):
        return sig
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rows = owner[cuts]
    x = (sh >> np.uint64(32)).astype(np.uint32)
    buf = np.empty_like(x)
    mul, add = _coefficients()
    for p in range(HASHES):
        np.multiply(x, mul[p], out=buf)
        np.add(buf, add[p], out=buf)
        sig[rows, p] = np.minimum.reduceat(buf, cuts)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = textbuf.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        out[:, b] = h
    return out


def least_matches(n: int, threshold: float = float(THRESHOLD), tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n values (bytes) that keep a pair.

    Under a uniform prior the posterior probability of reaching t after m matches of n is
    P(Binomial(n + 1, t) <= m).  Bytes also match by chance, once in 256.
    """
    t = threshold + (1 - threshold) / 256
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_LEAST = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) stay, comparing STEP more values at a time."""
    keep = np.arange(len(i))
    got = np.zeros(len(i), np.int32)
    for n, least in _LEAST:
        got = got + (sig[i[keep], n - STEP : n] == sig[j[keep], n - STEP : n]).sum(axis=1, dtype=np.int32)
        ok = got >= least
        keep, got = keep[ok], got[ok]
        if not len(keep):
            break
    return keep


def pairs(group: np.ndarray, side: np.ndarray, cross: np.ndarray, sig: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The surviving pairs of rows of the same group (rows sorted by group); in a cross group only of different sides."""
    out_i, out_j, wait_i, wait_j, waiting = [], [], [], [], 0

    def flush():
        i, j = np.concatenate(wait_i), np.concatenate(wait_j)
        keep = prune(sig, i, j)
        out_i.append(i[keep])
        out_j.append(j[keep])
        wait_i.clear()
        wait_j.clear()

    active, d, n = np.arange(len(group)), 1, len(group)
    while True:
        active = active[active + d < n]
        active = active[group[active] == group[active + d]]
        if not len(active):
            break
        use = active[~cross[active] | (side[active] != side[active + d])]
        if len(use):
            wait_i.append(use)
            wait_j.append(use + d)
            waiting += len(use)
        if waiting >= at_once:
            flush()
            waiting = 0
        d += 1
    if waiting:
        flush()
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def tied(sig: np.ndarray) -> np.ndarray:
    """A row of each row's component under the surviving pairs: every row is compared with the rows not reached yet."""
    root = np.arange(len(sig))
    left = np.arange(len(sig))
    while len(left):
        seed, left = left[0], left[1:]
        reached = [seed]
        while reached and len(left):
            x = reached.pop()
            some = prune(sig, np.broadcast_to(x, len(left)), left)
            if len(some):
                root[left[some]] = seed
                reached.extend(left[some].tolist())
                left = np.delete(left, some)
    return root


def roots(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The row of smallest ``order`` in each row's component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            if order[a] > order[b]:
                a, b = b, a
            parent[b] = a
    return np.array([find(x) for x in range(n)], np.int64)


def verify(data: np.ndarray, offsets: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Which pairs of texts reach the threshold, on their exact sets of shingles."""
    n = len(offsets) - 1
    sh, owner, _, _, _ = shingles(data, offsets)
    values, ids = np.unique(sh, return_inverse=True)
    both = np.unique(owner * len(values) + ids)
    owner, ids = both // max(1, len(values)), both % max(1, len(values))
    first = textbuf.per_doc(owner, n)
    size = np.diff(first)
    ok = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]])) if len(i) else np.zeros(0, np.int64)
    mark = np.zeros(len(values), np.int64)
    for lo, hi in zip(cuts, [*cuts[1:], len(i)], strict=True):
        rows = order[lo:hi]
        a, other = int(i[rows[0]]), j[rows]
        mine = ids[first[a] : first[a + 1]]
        mark[mine] = 1
        for s in range(0, len(other), 4096):
            part = other[s : s + 4096]
            part_n = size[part]
            hit = mark[ids[textbuf.ragged(first[part], part_n)]]
            common = np.add.reduceat(np.append(hit, 0), np.cumsum(part_n) - part_n)
            union = size[a] + part_n - common
            ok[rows[s : s + 4096]] = common * threshold.denominator >= union * threshold.numerator
        mark[mine] = 0
    return ok


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in textbuf.blocks(batches):
        data, offsets = textbuf.buffers(b.column("text"))
        n = b.num_rows
        sh, owner, n_words, k1, k2 = shingles(data, offsets)
        sig = minhash(sh, owner, n)
        none = n_words == 0
        keys = pa.array(k1.view(np.int64), mask=none)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column("doc_id"),
                "id1": b.column("id1"),
                "id2": b.column("id2"),
                "k1": keys,
                "k2": pa.array(k2.view(np.int64), mask=none),
                "n_words": pa.array(n_words, pa.int64()),
                "sig": pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), n, [None, pa.py_buffer(sig.astype(np.uint8).tobytes())]).cast(pa.binary()),
                "bands": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(band_keys(sig).view(np.int64).ravel())),
            }
        )


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int = 1 << 62) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by ``keys``: together at most ``rows`` rows and ``size`` bytes of text, or one group."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        t = pa.concat_tables(held)
        at = np.flatnonzero(np.diff(_group_numbers(t, keys))) + 1
        if not len(at):
            continue  # the group goes on
        last = int(at[-1])
        yield from _portions(t.slice(0, last).combine_chunks(), at, rows, size)
        held = [t.slice(last).combine_chunks()]
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield from _portions(t, np.append(np.flatnonzero(np.diff(_group_numbers(t, keys))) + 1, t.num_rows), rows, size)


def _portions(t: pa.Table, ends: np.ndarray, rows: int, size: int) -> Iterator[pa.Table]:
    """Slices of the table that end at group ends."""
    weight = textbuf.buffers(t.column("text"))[1] if "text" in t.column_names else np.zeros(t.num_rows + 1, np.int64)
    lo = last = 0
    for end in [int(e) for e in ends]:
        if last > lo and (end - lo > rows or weight[end] - weight[lo] > size):
            yield t.slice(lo, last - lo).combine_chunks()
            lo = last
        last = end
    if last > lo:
        yield t.slice(lo, last - lo).combine_chunks()


def _group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, np.int64)
    for k in keys:
        v = t.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def _sig(t: pa.Table) -> np.ndarray:
    data, _ = textbuf.buffers(t.column("sig"))
    return data.reshape(-1, HASHES)


_GROUP = ["grp", "bi", "bj"]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches, _GROUP, 1 << 14):
        node, sig = t.column("node").to_numpy(), _sig(t)
        group = _group_numbers(t, _GROUP)
        size = np.bincount(group)
        small = np.flatnonzero(size[group] <= LARGE_GROUP)
        cross = t.column("bi").to_numpy() != t.column("bj").to_numpy()
        i, j = pairs(group[small], t.column("blk").to_numpy()[small], cross[small], sig[small])
        # rows of different groups never meet in a pair, so one forest serves all groups
        root = np.arange(len(node))
        root[small] = small[roots(len(small), i, j, node[small])]
        ends = np.cumsum(size)
        for g in np.flatnonzero(size > LARGE_GROUP).tolist():
            lo, hi = int(ends[g] - size[g]), int(ends[g])
            root[lo:hi] = lo + tied(sig[lo:hi])
        some = np.flatnonzero(node != node[root])
        yield pa.RecordBatch.from_pydict({"a": pa.array(node[some]), "b": pa.array(node[root[some]])})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches, _GROUP, 1 << 14, 2 << 20):
        data, offsets = textbuf.buffers(t.column("text"))
        node = t.column("node").to_numpy()
        same = shingles(data, offsets)[3].view(np.int64) == node  # against equal hashes of different rows
        group = _group_numbers(t, _GROUP)
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (group[1:] != group[:-1])
        good = np.flatnonzero(same)
        if not fresh.all():  # one row per node and group
            good = good[np.unique(np.column_stack([group[good], node[good]]), axis=0, return_index=True)[1]]
        if len(good) < t.num_rows:
            t = t.take(pa.array(np.sort(good))).combine_chunks()
            data, offsets = textbuf.buffers(t.column("text"))
            node, group = t.column("node").to_numpy(), _group_numbers(t, _GROUP)
        cross = t.column("bi").to_numpy() != t.column("bj").to_numpy()
        i, j = pairs(group, t.column("blk").to_numpy(), cross, _sig(t))
        ok = verify(data, offsets, i, j)
        i, j = i[ok], j[ok]
        copies = t.column("copies").to_numpy()
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = roots(len(node), i, j, node)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict({"node": pa.array(node[some]), "root": pa.array(node[root[some]]), "links": pa.array(links[some])})


def _blocks(count: str, least: int, most: int) -> str:
    """SQL of the number of blocks: of ``least`` members up to 64 blocks, beyond that of up to ``most``."""
    return f"least(ceil({count} / {least}), greatest(64, ceil({count} / {most})))"


def _dealt(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every block that its own block meets: groups (grp, bi <= bj), numbered by ``task``."""
    mine = rows.withColumn("blk", F.expr(f"cast(pmod(xxhash64(node), {blocks}) as int)")).withColumn("other", F.expr(f"explode(sequence(0, cast({blocks} as int) - 1))"))
    met = mine.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other")
    return met.withColumn("task", F.expr("xxhash64(grp) + cast(bj as long) * (bj + 1) div 2 + bi"))


def _in_turn(dealt: DataFrame) -> DataFrame:
    """Rows sorted by group and node; the block pairs of a group, numbered without gaps, go to partitions in turn."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int")).sortWithinPartitions(*_GROUP, "node").drop("task")


def _among(docs: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """The rows whose id1 may be one of the n of ``side``: all of these and few others, found by broadcast bitmaps."""
    bits = min(MOST_BITS, max(20, (16 * n).bit_length()))
    place = lambda c: F.pmod(c, F.lit(1 << bits))
    marks = side.select(place(F.col("rep.id1")).alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.expr("cast(p % 32768 div 8 as int) + 1"), F.lit(1))), 16, 10).cast("long")
    held = docs.withColumn("p", place(F.col("id1"))).join(F.broadcast(marks), (F.expr("p div 32768") == F.col("part")) & (F.pmod(byte * F.lit(1), F.expr("shiftleft(2L, cast(p % 8 as int))")) >= F.expr("shiftleft(1L, cast(p % 8 as int))")), "left_semi")
    return held.drop("p")


def _identity(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Two 64-bit hashes of a row's id and text; rows that agree in both repeat."""
    row = [documents[doc_id].cast("long"), documents[doc_id].isNull(), documents[text]]
    return {"id1": F.xxhash64(*row), "id2": F.xxhash64(F.lit(1), *row)}


def _classed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, id1, id2, class_id, n_links, n_copies, and whether it is its class's root
    (the smallest id, ids before none; of its rows one text)."""
    docs = documents.select(documents[doc_id].cast("long").alias("doc_id"), documents[text].alias("text"), *[v.alias(k) for k, v in _identity(documents, doc_id, text).items()])
    signed = storage.stored(textbuf.small_batches(docs).mapInArrow(_signer, "doc_id long, id1 long, id2 long, k1 long, k2 long, n_words long, sig binary, bands array<long>"), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id1", "id2")
    reps = storage.stored(
        signed.filter("k1 is not null")
        .groupBy(F.col("k1").alias("node"), "k2")
        .agg(F.min(row).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "reps",
    )
    banded = reps.select("node", F.explode("bands").alias("grp"))
    buckets = banded.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.expr("bit_xor(xxhash64(node))").alias("x")).filter("m > 1")
    kept = buckets.groupBy("m", "lo", "hi", "x").agg(F.min("grp").alias("grp")).select("grp", "m")
    members = _dealt(banded.join(kept, "grp"), _blocks("m", 512, 8192))
    sent = _in_turn(members.join(reps.select("node", "sig"), "node").select(*_GROUP, "blk", "task", "node", "sig"))
    forest = sent.mapInArrow(_forests, "a long, b long").distinct()
    forest = storage.stored(forest, "forest")
    joined = connected_components(forest).select(F.col("id").alias("node"), F.col("component").alias("grp"))

    held = joined.join(reps.select("node", "rep", "copies", "n_words", "sig"), "node")
    sizes = held.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("w")).select("grp", F.expr(f"greatest({_blocks('m', BLOCK, 8 * BLOCK)}, ceil(w / {BLOCK_WORDS}))").alias("blocks"))
    held = held.join(sizes, "grp").drop("n_words")
    n = joined.count()
    few = n <= SMALL_TABLE // 10
    side = F.broadcast(held) if few else held
    texts = (docs if few else _among(docs, held, n)).join(side, (docs["id1"] == F.col("rep.id1")) & (docs["id2"] == F.col("rep.id2"))).select("grp", "node", "copies", "blocks", "sig", "text")
    groups = _dealt(texts, "blocks").select(*_GROUP, "blk", "task", "node", "copies", "sig", "text")
    links = storage.stored(_in_turn(groups).mapInArrow(_verified, "node long, root long, links long"), "links")

    per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(links, "node", "root").select(F.col("id").alias("node"), F.col("component").alias("part"))
    known = reps.select("node", "k2", "rep", "copies").join(parts, "node", "left").join(per_node, "node", "left").withColumn("part", F.coalesce("part", "node"))
    known = storage.stored(known, "known")
    named = known.groupBy("part").agg(F.min("rep").alias("root"))
    of_class = known.join(named, "part").select(F.col("node").alias("k1"), "k2", "root", "copies", "links")
    worded = (
        signed.filter("k1 is not null").select("doc_id", "id1", "id2", "k1", "k2").join(of_class, ["k1", "k2"])
        .select("doc_id", "id1", "id2", F.col("root.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), ((F.col("id1") == F.col("root.id1")) & (F.col("id2") == F.col("root.id2"))).alias("is_root"))
    )
    rest = signed.filter("k1 is null").select("doc_id", "id1", "id2", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("is_root"))
    return worded.unionByName(rest)


def classes(spark: SparkSession, documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: class_id (the smallest id of its near-duplicate class), n_links (documents
    that reach the threshold with it), n_copies (documents of equal words, itself included)."""
    return _classed(documents, doc_id, text).select("doc_id", "class_id", "n_links", "n_copies")


def deduplicated(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents with one of each near-duplicate class (the smallest id); columns stay.

    Rows go by their own id and text; texts without words all stay.
    """
    found = storage.stored(_classed(documents), "classes")
    one, two = textbuf.unused("_id1", documents), textbuf.unused("_id2", documents)
    pair = [F.col("id1").alias(one), F.col("id2").alias(two)]
    own = list(_identity(documents).values())
    gone = found.filter("not is_root").select(*pair).distinct()
    if found.filter("not is_root").count() <= SMALL_TABLE:
        gone = F.broadcast(gone)
    out = documents.join(gone, (own[0] == gone[one]) & (own[1] == gone[two]), "left_anti")
    doubled = storage.stored(found.filter("is_root and n_copies > 1").groupBy(*pair).count().filter("count > 1").drop("count"), "doubled")
    n = doubled.count()
    if not n:
        return out
    doubled = F.broadcast(doubled) if n <= SMALL_TABLE else doubled
    twice = (own[0] == doubled[one]) & (own[1] == doubled[two])
    once = out.join(doubled, twice, "left_semi").withColumns({one: own[0], two: own[1]}).dropDuplicates([one, two]).drop(one, two)
    return out.join(doubled, twice, "left_anti").unionByName(once)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _classed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", F.coalesce(F.col("doc_id") == F.col("class_id"), "is_root").alias("kept"))


#: The same rows in DuckDB: all pairs of documents that share a shingle, then everything reachable.
OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') as g from w, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) as u(i) where len(ws) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 5 * k >= 4 * (na.n + nb.n - k)),
reach as (select doc_id as id, doc_id as seen from documents union select r.id, l.b from reach r join link l on l.a = r.seen),
cls as (select id, min(seen) as class_id from reach group by id),
links as (select a as doc_id, count(*) as n_links from link group by a),
copies as (select array_to_string(ws, ' ') as t, count(*) as n_copies from w where len(ws) > 0 group by 1)
select w.doc_id, class_id, coalesce(n_links, 0) as n_links, coalesce(n_copies, 1) as n_copies, w.doc_id = class_id as kept
from w join cls on cls.id = w.doc_id left join links using (doc_id) left join copies on len(ws) > 0 and t = array_to_string(ws, ' ')
"""
