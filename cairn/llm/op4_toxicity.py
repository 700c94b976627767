"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input vector is its own embedding (words of the vocabulary; others share none) plus the
mean embedding of its character 3-grams.  A window of 32 words runs through a gated
recurrent unit in either direction; attention pools the states, and a linear unit gives the
window's logit.  A text's windows overlap by half, all of them are scored, and the largest
logit, calibrated, is the text's score.

The network is trained here, in numpy, by back-propagation through time on a bounded sample
of labelled rows (of each label at most ``DOCS_PER_CLASS`` different texts of at most ``LONGEST_SAMPLE``
bytes, by a hash of id and text, however often ids or rows repeat).  A toxic text need not be toxic throughout: the window that trains
for it is at first the one with the most telling word, then the one that the network itself
scores highest; windows of other texts train as they are, the highest ones each time.

Scale: the model is a few MB and broadcast; scoring is one pass in Arrow batches over whole
texts, without a shuffle, each distinct word of a block being prepared once.

Edge cases: null, empty and wordless texts score 0; without labels of both kinds everything
scores 0; repeated rows score alike; null labels are not learned; of several labels of an id
the largest counts; an empty table gives an empty result; a very long text is a block of its own
(about 16 times its bytes); extra columns are passed through (``score`` and ``predicted`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import textbuf

T, STRIDE = 32, 16
DIM, HIDDEN = 16, 8
GRAM_BITS = 16
DOCS_PER_CLASS = 1200
LONGEST_SAMPLE = 1 << 15
VOCABULARY_LEAST = 4
EPOCHS, ROUNDS, BATCH = 4, 6, 256
THRESHOLD = 0.7
BLOCK_BYTES = 2 << 20
SEED = 20240229
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed 3-grams, offsets per word) of words between boundary marks."""
    size = ends - starts + 2
    begin = np.cumsum(size) - size
    marked = np.empty(int(size.sum()), np.uint8)
    marked[begin], marked[begin + size - 1] = 0x5E, 0x24
    marked[textbuf.ragged(begin + 1, size - 2)] = low[textbuf.ragged(starts, size - 2)]
    code = marked[:-2].astype(np.uint32) | marked[1:-1].astype(np.uint32) << 8 | marked[2:].astype(np.uint32) << 16 if len(marked) else np.zeros(0, np.uint32)
    code = code * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)
    return code[textbuf.ragged(begin, size - 2)].astype(np.int64), np.concatenate([[0], np.cumsum(size - 2)])


@dataclass
class Words:
    """The distinct words of a block, and the windows of its texts as rows of word numbers (len(words) pads)."""

    hashes: np.ndarray
    grams: np.ndarray
    offsets: np.ndarray
    windows: np.ndarray
    owner: np.ndarray


def prepared(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, doc, h = textbuf.words(data, offsets)
    hashes, first, code = np.unique(h, return_index=True, return_inverse=True)
    g, at = grams(textbuf.LOWER[data], starts[first], ends[first])
    begin = textbuf.per_doc(doc, len(offsets) - 1)
    n = np.diff(begin)
    count = np.where(n > 0, np.maximum(1, -(-(n - T) // STRIDE) + 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = begin[owner] + textbuf.ragged(np.zeros(len(n), np.int64), count) * STRIDE
    place = start[:, None] + np.arange(T)
    padded = np.append(code, len(hashes)).astype(np.int32)
    windows = padded[np.where(place < begin[owner + 1][:, None], place, len(code))] if len(owner) else np.zeros((0, T), np.int32)
    return Words(hashes, g, at, windows, owner)


class Network:
    """The parameters, and the passes over windows."""

    def __init__(self, vocabulary: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # sorted word hashes; embedding 0 is that of no word
        self.word = (r.normal(0, 0.1, (len(vocabulary) + 1, DIM))).astype(np.float32)
        self.word[0] = 0
        self.gram = (r.normal(0, 0.1, (1 << GRAM_BITS, DIM))).astype(np.float32)
        scale = 1 / np.sqrt(DIM)
        self.p = {
            "W": r.normal(0, scale, (2, DIM, 3 * HIDDEN)),
            "U": r.normal(0, 1 / np.sqrt(HIDDEN), (2, HIDDEN, 3 * HIDDEN)),
            "b": np.zeros((2, 3 * HIDDEN)),
            "v": r.normal(0, 0.1, 2 * HIDDEN),
            "o": r.normal(0, 0.3, 2 * HIDDEN),
            "c": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.slope, self.shift = 1.0, 0.0

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def vectors(self, w: Words) -> np.ndarray:
        """The input vector of each distinct word."""
        if not len(w.hashes):
            return np.zeros((0, DIM), np.float32)
        mean = np.add.reduceat(self.gram[w.grams], w.offsets[:-1], axis=0) / np.diff(w.offsets)[:, None].astype(np.float32)
        return self.word[self.known(w.hashes)] + mean

    def logits(self, w: Words, at_once: int = 1024) -> np.ndarray:
        """The logit of every window."""
        p, x = self.p, self.vectors(w)
        tables, weights = [], []
        for d in (0, 1):
            for k, scale in enumerate((0.5, 0.5, 1.0)):  # the gates' sigmoid is a tanh of half its argument
                own = slice(k * HIDDEN, (k + 1) * HIDDEN)
                g = np.zeros((len(x) + 1, HIDDEN), np.float32)
                g[:-1] = (x @ p["W"][d][:, own] + p["b"][d][own]) * np.float32(scale)
                if k == 0:
                    g[-1] = 30  # a pad keeps the state
                tables.append(g)
                weights.append(np.ascontiguousarray(p["U"][d][:, own] * np.float32(scale)))
        half = np.float32(0.5)
        out = np.empty(len(w.windows), np.float32)
        for lo in range(0, len(w.windows), at_once):
            codes = np.ascontiguousarray(w.windows[lo : lo + at_once].T)
            n = codes.shape[1]
            states = np.empty((2, T, n, HIDDEN), np.float32)
            z, r, new = (np.empty((n, HIDDEN), np.float32) for _ in range(3))
            for d in (0, 1):
                gz, gr, gn = tables[3 * d : 3 * d + 3]
                uz, ur, un = weights[3 * d : 3 * d + 3]
                h = np.zeros((n, HIDDEN), np.float32)
                for t in range(T) if d == 0 else range(T - 1, -1, -1):
                    at = codes[t]
                    np.matmul(h, uz, out=z)
                    z += gz[at]
                    np.tanh(z, out=z)
                    z *= half
                    z += half
                    np.matmul(h, ur, out=r)
                    r += gr[at]
                    np.tanh(r, out=r)
                    r *= half
                    r += half
                    np.matmul(h, un, out=new)
                    new *= r
                    new += gn[at]
                    np.tanh(new, out=new)
                    h = np.subtract(h, new, out=states[d, t])
                    h *= z
                    h += new
            score = states[0] @ p["v"][:HIDDEN] + states[1] @ p["v"][HIDDEN:]
            score[codes == len(x)] = -1e9
            score -= score.max(axis=0)
            weight = np.exp(score, out=score)
            weight /= weight.sum(axis=0)
            value = states[0] @ p["o"][:HIDDEN] + states[1] @ p["o"][HIDDEN:]
            out[lo : lo + n] = (value * weight).sum(axis=0) + p["c"][0]
        return out

    def text_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest window logit of each text; -inf without words."""
        w = prepared(data, offsets)
        out = np.full(len(offsets) - 1, -np.inf)
        if len(w.owner):
            cuts = np.flatnonzero(np.concatenate([[True], w.owner[1:] != w.owner[:-1]]))
            out[w.owner[cuts]] = np.maximum.reduceat(self.logits(w), cuts)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = self.text_logits(data, offsets)
        z = np.clip(self.slope * np.maximum(logit, -1e6) + self.shift, -500, 500)
        return np.where(np.isfinite(logit), 1 / (1 + np.exp(-z)), 0.0)

    def gradients(self, codes: np.ndarray, x: np.ndarray, pad: int, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(of the parameters, of the word vectors) for windows with labels; codes[t, window], pad rows are ``pad``."""
        p, n, H = self.p, codes.shape[1], HIDDEN
        real = (codes != pad)[:, :, None]
        xs = np.concatenate([x, np.zeros((1, DIM), np.float32)])[codes]
        states = np.zeros((T, n, 2 * H), np.float32)
        saved: list[list] = [[], []]
        for d in (0, 1):
            g = xs @ p["W"][d] + p["b"][d]
            h = np.zeros((n, H), np.float32)
            for t in range(T) if d == 0 else range(T - 1, -1, -1):
                hu = h @ p["U"][d]
                zr = 1 / (1 + np.exp(-(g[t, :, : 2 * H] + hu[:, : 2 * H])))
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(g[t, :, 2 * H :] + r * hu[:, 2 * H :])
                nxt = np.where(real[t], new + z * (h - new), h)
                saved[d].append((t, h, z, r, new, hu[:, 2 * H :]))
                h = nxt
                states[t, :, d * H : (d + 1) * H] = h
        score = np.where(real[:, :, 0], states @ p["v"], -1e9)
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (states * a[:, :, None]).sum(axis=0)
        y = 1 / (1 + np.exp(-(pooled @ p["o"] + p["c"][0])))
        dy = ((y - label) * weight / n).astype(np.float32)
        grad = {k: np.zeros_like(q) for k, q in p.items()}
        grad["o"], grad["c"] = pooled.T @ dy, np.array([dy.sum()], np.float32)
        dpool = dy[:, None] * p["o"]
        ds = a[:, :, None] * dpool
        da = (states * dpool).sum(axis=2)
        dscore = a * (da - (a * da).sum(axis=0))
        grad["v"] = np.tensordot(dscore, states, ((0, 1), (0, 1)))
        ds = ds + dscore[:, :, None] * p["v"]
        dxs = np.zeros_like(xs)
        for d in (0, 1):
            dh = np.zeros((n, H), np.float32)
            dg = np.zeros((T, n, 3 * H), np.float32)
            for t, h, z, r, new, hn in reversed(saved[d]):
                dh = dh + ds[t, :, d * H : (d + 1) * H]
                keep = real[t]
                dnew = np.where(keep, dh * (1 - z) * (1 - new * new), 0)
                dz = np.where(keep, dh * (h - new) * z * (1 - z), 0)
                dr = dnew * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dnew * r], axis=1)
                dg[t] = np.concatenate([dz, dr, dnew], axis=1)
                grad["U"][d] += h.T @ dhu
                dh = np.where(keep, dh * z, dh) + dhu @ p["U"][d].T
            grad["W"][d] = np.tensordot(xs, dg, ((0, 1), (0, 1)))
            grad["b"][d] = dg.sum(axis=(0, 1))
            dxs += dg @ p["W"][d].T
        dx = np.zeros((len(x) + 1, DIM), np.float32)
        np.add.at(dx, codes.ravel(), dxs.reshape(-1, DIM))
        return grad, dx[:-1]


class _Optimiser:
    """Adam for the small parameters, a per-row adaptive rate for the embeddings that a batch touches."""

    def __init__(self, net: Network, rate: float = 0.01, embed_rate: float = 0.05):
        self.net, self.rate, self.embed_rate, self.t = net, rate, embed_rate, 0
        self.m = {k: np.zeros_like(x) for k, x in net.p.items()}
        self.s = {k: np.zeros_like(x) for k, x in net.p.items()}
        self.word, self.gram = np.full(len(net.word), 1e-8, np.float32), np.full(len(net.gram), 1e-8, np.float32)

    def step(self, grad: dict[str, np.ndarray], dx: np.ndarray, w: Words, rows: np.ndarray) -> None:
        """``dx``: gradients of the vectors of the words ``rows``."""
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            self.net.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
        own = self.net.known(w.hashes[rows])
        self._rows(self.net.word, self.word, own[own > 0], dx[own > 0])
        n = w.offsets[rows + 1] - w.offsets[rows]
        self._rows(self.net.gram, self.gram, w.grams[textbuf.ragged(w.offsets[rows], n)], np.repeat(dx / n[:, None], n, axis=0))

    def _rows(self, table: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        if not len(rows):
            return
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], rows[order][1:] != rows[order][:-1]]))
        unique, g = rows[order][first], np.add.reduceat(grad[order], first, axis=0)
        seen[unique] += (g * g).mean(axis=1)
        table[unique] -= self.embed_rate * g / np.sqrt(seen[unique])[:, None]


def learn(samples: list[tuple[int, str]], seed: int = SEED) -> Network | None:
    """Train on (label, text); None unless both labels occur."""
    if len({y for y, _ in samples}) < 2:
        return None
    data, offsets = textbuf.buffers(pa.array([t for _, t in samples], pa.large_string()))
    w = prepared(data, offsets)
    label = np.array([y for y, _ in samples], np.float32)
    if not len(w.owner):
        return None
    r = np.random.default_rng(seed)
    # documents of each label that hold each word
    doc_word = np.unique(w.owner[:, None] * (len(w.hashes) + 1) + w.windows)
    d, k = doc_word // (len(w.hashes) + 1), doc_word % (len(w.hashes) + 1)
    d, k = d[k < len(w.hashes)], k[k < len(w.hashes)]
    toxic = np.bincount(k, label[d], len(w.hashes))
    other = np.bincount(k, 1 - label[d], len(w.hashes))
    net = Network(np.sort(w.hashes[toxic + other >= VOCABULARY_LEAST]), seed)
    telling = toxic / max(1.0, label.sum()) - 3 * other / max(1.0, (1 - label).sum())
    value = np.append(telling, -9)[w.windows].max(axis=1)
    begin = np.flatnonzero(np.concatenate([[True], w.owner[1:] != w.owner[:-1]]))
    end = np.append(begin[1:], len(w.owner))
    opt = _Optimiser(net)
    for turn in range(ROUNDS):
        chosen, target = [], []
        for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
            best = lo + int(value[lo:hi].argmax())
            chosen.append(best)
            target.append(label[w.owner[lo]])
            if not label[w.owner[lo]] and hi - lo > 1:
                chosen.append(int(r.integers(lo, hi)))
                target.append(0.0)
        # windows that say one or two words of other texts over and over are not toxic either: those scored highest
        again = _repeats(w, np.flatnonzero(toxic == 0), label, r, 16 * len(chosen) if turn else len(chosen) // 3)
        if turn and len(again):
            score = net.logits(Words(w.hashes, w.grams, w.offsets, again, w.owner[:0]))
            again = again[np.argsort(-score, kind="stable")[: len(chosen) // 3]]
        pool = np.concatenate([w.windows, again])
        chosen, target = np.append(chosen, np.arange(len(w.windows), len(pool))), np.append(target, np.zeros(len(again))).astype(np.float32)
        weight = np.where(target > 0, len(target) / (2 * max(1.0, target.sum())), len(target) / (2 * max(1.0, (1 - target).sum())))
        for _ in range(EPOCHS):
            order = r.permutation(len(chosen))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                rows, codes = np.unique(pool[chosen[some]], return_inverse=True)
                real = rows < len(w.hashes)
                part = rows[real]
                n = w.offsets[part + 1] - w.offsets[part]
                sub = Words(w.hashes[part], w.grams[textbuf.ragged(w.offsets[part], n)], np.append(np.cumsum(n) - n, n.sum()), w.windows[:0], w.owner[:0])
                x = net.vectors(sub)
                codes = codes.reshape(len(some), T).T
                grad, dx = net.gradients(codes, x, len(part), target[some], weight[some])
                opt.step(grad, dx, w, part)
        if turn < ROUNDS - 1:
            value = net.logits(w)
    _calibrate(net, data, offsets, label)
    return net


def _repeats(w: Words, calm: np.ndarray, label: np.ndarray, r: np.random.Generator, count: int) -> np.ndarray:
    """Windows of one or two words: half the words drawn as they occur in other texts, half evenly among those."""
    if not len(calm):
        return np.zeros((0, T), np.int32)
    other = w.windows[r.choice(np.flatnonzero(label[w.owner] == 0), count), :2] if (label[w.owner] == 0).any() else np.zeros((0, 2), np.int32)
    words = np.where(r.random((len(other), 1)) < 0.5, other, r.choice(calm, (len(other), 2)))
    return np.where(np.arange(T) < r.integers(1, 2 * T, (len(words), 1)), words[:, :1], words[:, 1:]).astype(np.int32)


def _calibrate(net: Network, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> None:
    """Fit the score as a logistic function of the largest logit (Newton steps with a little ridge), and move
    it so that THRESHOLD lies where the two kinds of errors balance best."""
    z = np.clip(net.text_logits(data, offsets), -30, 30)
    a, b = 1.0, 0.0
    for _ in range(25):
        y = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q = y * (1 - y) + 1e-6
        g = np.array([((y - label) * z).sum() + 1e-2 * (a - 1), (y - label).sum()])
        h = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum()]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    a = float(np.clip(a, 0.05, 20))
    order = np.argsort(z)
    zs, ys = z[order], label[order]
    wrong = np.append(0, np.cumsum(ys)) + np.append(np.cumsum((1 - ys)[::-1])[::-1], 0)  # below a cut: toxic ones missed; above: others caught
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
    cut = float(edges[best].mean()) if len(best) else 0.0
    net.slope, net.shift = a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * cut)


def sample(documents: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS, longest: int = LONGEST_SAMPLE) -> list[tuple[int, str]]:
    """A bounded sample of labelled rows: first ids by their hash, thinned before they are ranked, then their texts."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.expr(HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {x[0]: x[1] for x in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return []
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * per_class / n))])
    thin = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(rate, F.col("toxic")) * (1 << 30))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    # twice as many ids as texts are wanted, for ids without a text or with one that is too long
    ids = thin.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * per_class).select(F.col("doc_id").alias("id"), "toxic")
    texts = documents.select("doc_id", "text").filter(F.octet_length("text") <= longest).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    texts = texts.select("toxic", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("h2")).dropDuplicates(["toxic", "h2"])
    rows = texts.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "h2"))).filter(F.col("r") <= per_class).select("toxic", "text").collect()
    return sorted((x["toxic"], x["text"]) for x in rows)


def scored(spark: SparkSession, rows: DataFrame, net: Network | None) -> DataFrame:
    """The rows with ``score`` and ``predicted`` (columns of these names are replaced); only ``text`` is looked at."""
    kept = [f for f in rows.schema.fields if f.name not in ("score", "predicted")]
    bc = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for b in textbuf.blocks(batches, limit=BLOCK_BYTES):
            score = np.zeros(b.num_rows) if model is None else model.scores(*textbuf.buffers(b.column("text")))
            yield pa.RecordBatch.from_pydict({**{f.name: b.column(f.name) for f in kept}, "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    schema = StructType([*kept, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return textbuf.small_batches(rows).select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text")
    return scored(spark, rows, net).select("doc_id", "held_out", "score", "predicted")
