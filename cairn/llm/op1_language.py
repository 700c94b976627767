"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (plus the 256
single bytes, so that nothing is unscorable).  A word's probability is the sum over all its
segmentations into pieces, found by a forward algorithm; the probabilities are learned by
expectation-maximisation with the matching backward pass.  A text is the product of its
words, and the posterior under equal priors gives the language and the score.

Learning takes a bounded sample: of each language at most ``DOCS_PER_LANG`` different texts of at
most ``LONGEST_SAMPLE`` bytes and together ``BYTES_PER_LANG`` bytes, chosen by a hash of id and text,
however often ids or rows repeat.  Prediction reads every text once in Arrow batches, scores each
distinct word of a block once, and shuffles nothing.

Edge cases: a null text, an empty one and one without any letter get ``und`` and score 0;
words of digits only are ignored; a word over ``UNIT`` bytes is scored in units of about that
size, parted between characters, so no text is cut short; null languages and rows without an id are not
learned; with no labelled row everything is ``und``; an empty table gives an empty result; repeated rows
are scored alike; a very long text is a block of its own (about 23 times its bytes); extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import spm_model, textbuf

VOCABULARY = "piece_bpe_32k.model"
DOCS_PER_LANG = 300
BYTES_PER_LANG = 1_000_000
LONGEST_SAMPLE = 1 << 16
UNIT = 64
ROUNDS = 4
SMOOTH = 0.05
BLOCK_BYTES = 2 << 20
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


class Pieces:
    """The vocabulary as a hash table from 64-bit span hashes to piece numbers (0: none)."""

    BITS = 20

    def __init__(self, path: str):
        texts = {bytes([b]) for b in range(256)}
        for piece, _, kind in spm_model.parse(path).pieces:
            if kind == spm_model.NORMAL:
                raw = piece.replace(spm_model.SPACE, " ").lower().encode()
                if 0 < len(raw) <= UNIT + 1:  # a longer one is in no unit
                    texts.add(raw)
        self.texts = [b"", *sorted(texts)]
        self.lengths = sorted({len(t) for t in texts})
        joined = b"".join(self.texts)
        ends = np.cumsum([len(t) for t in self.texts])
        starts = np.concatenate([[0], ends[:-1]])
        self.keys = _spans(np.frombuffer(joined, np.uint8), starts, ends)
        self.first = np.zeros(1 << self.BITS, np.int32)
        self.second = np.zeros(1 << self.BITS, np.int32)
        number = np.arange(len(self.texts), dtype=np.int32)
        self.first[self._slot(self.keys[1:], 0)] = number[1:]
        beaten = number[1:][self.first[self._slot(self.keys[1:], 0)] != number[1:]]
        self.second[self._slot(self.keys[beaten], 1)] = beaten
        lost = beaten[self.second[self._slot(self.keys[beaten], 1)] != beaten]
        self.keys[0] = 0
        self.dropped = len(lost)  # multi-byte pieces only could be; they are then spelled by others

    def _slot(self, h: np.ndarray, which: int) -> np.ndarray:
        return ((h >> np.uint64(20 * which)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        a = self.first[self._slot(h, 0)]
        b = self.second[self._slot(h, 1)]
        return np.where(self.keys[a] == h, a, np.where((b > 0) & (self.keys[b] == h), b, 0))


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return textbuf.span_hash(data, starts, ends)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scoring units of a block: (bytes, starts, lengths of the distinct units; unit and document of each occurrence)."""
    starts, ends, doc, h = textbuf.words(data, offsets)
    low = textbuf.LOWER[data]
    letters = np.concatenate([[0], np.cumsum(low >= 0x61, dtype=np.int32 if len(low) < 1 << 31 else np.int64)])
    keep = letters[ends] > letters[starts]
    starts, ends, doc, h = starts[keep], ends[keep], doc[keep], h[keep]
    long = ends - starts > UNIT
    if long.any():
        # at every UNIT bytes, or before the character that lies there, of at most four bytes
        n = -(-(ends - starts) // (UNIT - 3))
        row = np.repeat(np.arange(len(starts)), n)
        s = starts[row] + textbuf.ragged(np.zeros(len(n), np.int64), n) * (UNIT - 3)
        padded = np.append(low, np.uint8(0))
        for _ in range(3):
            s += (padded[s] & 0xC0) == 0x80
        s = np.minimum(s, ends[row])
        e = np.append(s[1:], 0)
        last = np.cumsum(n) - 1
        e[last] = ends
        some = e > s
        starts, ends, doc = s[some], e[some], doc[row][some]
        h = _spans(low, starts, ends)
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    return low, starts[first], (ends - starts)[first], code, doc


@dataclass
class Lattice:
    """All piece edges of the units of one byte length (with the marker): by (end, size)."""

    rows: np.ndarray
    n: int
    edges: list[tuple[int, int, np.ndarray, np.ndarray]]


def lattices(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces) -> Iterator[Lattice]:
    """A space marks the start of each unit, as in the vocabulary."""
    up, down = textbuf.powers(UNIT + 2)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        n = int(size) + 1
        chars = np.empty((n, len(rows)), np.uint64)
        chars[0] = 0x20
        for i in range(1, n):
            chars[i] = low[starts[rows] + i - 1]
        sums = np.zeros((n + 1, len(rows)), np.uint64)
        np.cumsum((chars + np.uint64(1)) * up[:n, None], axis=0, out=sums[1:])
        edges = []
        for end in range(1, n + 1):
            for k in [x for x in pieces.lengths if x <= end]:
                found = pieces.find(textbuf.mix((sums[end] - sums[end - k]) * down[end - k]))
                hit = np.flatnonzero(found)
                if len(hit):
                    edges.append((end, k, hit, found[hit]))
        yield Lattice(rows, n, edges)


SCALE = 8.0  # every byte raises a probability by this power of e, so that no unit's leaves the numbers


def raised(pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    return prob * np.exp(SCALE * np.array([len(t) for t in pieces.texts]))[:, None]


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """alpha[position, unit, language]: the summed (raised) probability of all segmentations of the prefix."""
    alpha = np.zeros((lat.n + 1, len(lat.rows), prob.shape[1]))
    alpha[0] = 1
    for end, k, hit, piece in lat.edges:
        if len(hit) == len(lat.rows):
            alpha[end] += alpha[end - k] * prob[piece]
        else:
            alpha[end, hit] += alpha[end - k, hit] * prob[piece]
    return alpha


def log_scores(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts), prob.shape[1]))
    high = raised(pieces, prob)
    for lat in lattices(low, starts, lengths, pieces):
        out[lat.rows] = np.log(forward(lat, high)[lat.n]) - SCALE * lat.n
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray

    def score_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, -1 for none; posterior) of each text."""
        n, k = len(texts), len(self.languages)
        if not k:
            return np.full(n, -1), np.zeros(n)
        data, offsets = textbuf.buffers(texts)
        low, starts, lengths, code, doc = units(data, offsets)
        total = np.zeros((n, k))
        if len(code):
            each = log_scores(low, starts, lengths, self.pieces, self.prob)[code]
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            total[doc[cuts]] = np.add.reduceat(each, cuts, axis=0)
        total -= total.max(axis=1, keepdims=True)
        post = np.exp(total)
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        score = post[np.arange(n), best]
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


def learn(samples: list[tuple[str, str]], vocabulary: str, rounds: int = ROUNDS) -> LanguageModel:
    """Expectation-maximisation over the distinct words of (language, text) samples."""
    pieces = Pieces(vocabulary)
    languages = sorted({lang for lang, _ in samples})
    by = {lang: i for i, lang in enumerate(languages)}
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces.texts), 0)))
    data, offsets = textbuf.buffers(pa.array([t for _, t in samples], pa.string()))
    low, starts, lengths, code, doc = units(data, offsets)
    lang_of = np.array([by[lang] for lang, _ in samples])
    counts = np.zeros((len(starts), len(languages)))
    np.add.at(counts, (code, lang_of[doc]), 1)
    lats = list(lattices(low, starts, lengths, pieces))
    size = len(pieces.texts)

    def normal(expected: np.ndarray) -> np.ndarray:
        p = expected + SMOOTH
        p[0] = 0
        return p / p.sum(axis=0)

    start = np.zeros((size, len(languages)))
    for lat in lats:
        for _, _, hit, piece in lat.edges:
            for j in range(len(languages)):
                start[:, j] += np.bincount(piece, counts[lat.rows[hit], j], size)
    prob = normal(start)
    for _ in range(rounds):
        expected = np.zeros_like(prob)
        high = raised(pieces, prob)
        for lat in lats:
            alpha = forward(lat, high)
            beta = np.zeros_like(alpha)
            beta[lat.n] = 1
            weight = counts[lat.rows] / alpha[lat.n]
            for end, k, hit, piece in reversed(lat.edges):
                flow = high[piece] * beta[end, hit]
                beta[end - k, hit] += flow
                share = alpha[end - k, hit] * flow * weight[hit]
                for j in range(len(languages)):
                    expected[:, j] += np.bincount(piece, share[:, j], size)
        prob = normal(expected)
    return LanguageModel(languages, pieces, prob)


def sample(documents: DataFrame, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG, longest: int = LONGEST_SAMPLE) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: (language, text)."""
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.expr(HELD_OUT) & (F.octet_length("text") <= longest))
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # a rate for each language that leaves about twice the texts wanted, so that ranking them costs nothing at any size
    rates = {r[0]: min(1.0, 2 * docs_per_lang / max(1, r[1])) for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not rates:
        return []
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    thin = labelled.filter(F.pmod("h", F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30)).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    ranked = thin.withColumns({"r": F.row_number().over(order), "b": F.sum(F.octet_length("text")).over(order)})
    rows = ranked.filter((F.col("r") <= docs_per_lang) & (F.col("b") <= bytes_per_lang)).select("lang", "text").collect()
    return sorted((r["lang"], r["text"]) for r in rows)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def train(documents: DataFrame, vocabulary: str | None = None) -> LanguageModel:
    return learn(sample(documents), vocabulary or vocabulary_path())


def _batches(bc, passed: list[str], added: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = bc.value
        names = pa.array([*model.languages, "und"], pa.string())
        for b in textbuf.blocks(batches, limit=BLOCK_BYTES):
            best, score = model.score_block(b.column("text"))
            cols = {c: b.column(c) for c in passed}
            cols[added[0]] = names.take(pa.array(np.where(best < 0, len(model.languages), best)))
            cols[added[1]] = pa.array(score)
            yield pa.RecordBatch.from_pydict(cols)

    return run


def predict(spark: SparkSession, rows: DataFrame, model: LanguageModel, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` under these or other names (columns so named are replaced); only ``text`` is looked at."""
    kept = [f for f in rows.schema.fields if f.name not in added]
    schema = StructType([*kept, StructField(added[0], StringType()), StructField(added[1], DoubleType())])
    return textbuf.small_batches(rows).select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(_batches(spark.sparkContext.broadcast(model), [f.name for f in kept], added), schema)


def accepted(spark: SparkSession, documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a language: not ``und``, and the best posterior is at least ``least``.  All columns stay as they are."""
    added = textbuf.unused("_lang_pred", documents), textbuf.unused("_score", documents)
    scored = predict(spark, documents, train(documents), added)
    return scored.filter((F.col(added[0]) != "und") & (F.col(added[1]) >= least)).drop(*added)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    rows = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text")
    return predict(spark, rows, model).select("doc_id", "held_out", "lang_pred", "score")
