"""SentencePiece encoding and decoding on the tokenizers library.

``build`` parses the model's protobuf and rebuilds it: the character map as normaliser, the
dummy prefix and the space marker, unigram scores (or, for a merge model, the merges that its
scores imply) and byte fallback.  ``Codec`` encodes whole texts in batches and decodes ids.  What it
encodes it checks against the SentencePiece library, and decodes by the tokenizers library; a difference
is an error.  ``parity`` lists the differences of given texts.

Ids of whole texts are decoded by a table of what the library spells for each id, since its own decoder takes
many times as long (143 CPU seconds a GB of text against 11); both give the same, which is checked for every
distinct unit.

For merge models a text is encoded by distinct units: no piece holds a space marker
behind another character, or a character that the model spells in bytes, so a text may be cut
before every space that follows another character and around such characters.  Each unit is
checked both ways when it is first encoded.  Texts of other models are encoded and checked whole.

Scale: each text is encoded whole in Arrow batches and nothing is shuffled; batches of units and of
ids go to the library together, which spreads them over threads (``units.threaded``).

Edge cases: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded alike; an empty table gives an empty result; a very long text is a block of its own (about
17 times its bytes); extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spm_model, textbuf
from .spm_model import SPACE, SpmModel
from .units import THREADS, UnitEncoder, joined, threaded

MODEL = "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20
DECODED_IDS = 1 << 18  # spelled at once


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def implied_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges of a scored vocabulary: every split of a piece into two pieces, the best piece first."""
    score = {p: s for p, s, kind in pieces if kind in (spm_model.NORMAL, spm_model.USER_DEFINED)}
    number = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = []
    for piece in score:
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                found.append((-score[piece], number[piece], number[left], number[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: SpmModel, prefix: bool | None = None, strip: bool = True):
    """The tokenizers.Tokenizer of a model; ``prefix`` overrides its dummy prefix, ``strip`` takes it off decoded text."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unk_id][0]
    prefix = model.add_dummy_prefix if prefix is None else prefix
    if model.model_type == spm_model.UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.model_type == spm_model.BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocabulary, merges=implied_merges(model.pieces), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and merge models are supported")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
    if prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer = Tokenizer(core)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Replace(unk, " ⁇ "), decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_dummy_prefix and strip:
        ends.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(ends)
    return tokenizer


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class Codec:
    """Encoding and decoding of one model in one process."""

    def __init__(self, path: str, verified: bool = True):
        threaded()
        self.model = spm_model.parse(path)
        self.by_units = self._separable()
        # the one for units neither adds nor takes off the dummy prefix
        self.tokenizer = build(self.model, prefix=False, strip=False) if self.by_units else build(self.model)
        self.judge = _judge(path, prefix=not self.by_units) if verified else None
        if self.by_units:
            starts = np.array([p.startswith(SPACE) for p, _, _ in self.model.pieces])
            self.units = UnitEncoder(lambda units: self._checked(units, *joined(self.tokenizer, starts, units, _simple)), _cuts)
        spell = self.tokenizer if self.by_units else build(self.model, strip=False)
        spelled = [self._spelling(spell, i, piece, kind) for i, (piece, _, kind) in enumerate(self.model.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_ends = np.cumsum([0, *map(len, spelled)])

    @staticmethod
    def _spelling(tokenizer, number: int, piece: str, kind: int) -> bytes:
        """What an id stands for: bytes for themselves, control ids for nothing, the others for what the library spells."""
        if kind == spm_model.BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == spm_model.CONTROL else tokenizer.decode([number], skip_special_tokens=False).encode()

    def _checked(self, texts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, if the SentencePiece library gives the same."""
        if self.judge is not None and texts:
            theirs = self.judge.encode([t.decode() for t in texts], num_threads=THREADS)
            flat = np.fromiter((x for t in theirs for x in t), np.uint32)
            if not (np.array_equal(flat, ids) and np.array_equal(sizes, [len(t) for t in theirs])):
                ends = np.concatenate([[0], np.cumsum(sizes)])
                wrong = next(t for t, their, lo, hi in zip(texts, theirs, ends[:-1], ends[1:], strict=True) if their != ids[lo:hi].tolist())
                raise ValueError(f"the SentencePiece library encodes {wrong[:200]!r} otherwise")
            back = self.tokenizer.decode_batch(theirs, skip_special_tokens=False)
            if back != ([t.decode() for t in texts] if self.by_units else self.judge.decode(theirs)):
                raise ValueError("the library decodes some ids otherwise")
        return ids, sizes

    def _separable(self) -> bool:
        """Whether cutting by units is exact for this model."""
        m = self.model
        if m.model_type != spm_model.BPE or not m.byte_fallback or m.charsmap or m.remove_extra_whitespaces or not (m.add_dummy_prefix and m.escape_whitespaces):
            return False
        normal = [p for p, _, kind in m.pieces if kind in (spm_model.NORMAL, spm_model.USER_DEFINED)]
        return not any((SPACE in p.lstrip(SPACE)) or "\n" in p for p in normal)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each)."""
        data, offsets = textbuf.buffers(texts)
        if not self.by_units:
            whole = [t or "" for t in texts.to_pylist()]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return self._checked([t.encode() for t in whole], np.fromiter((x for g in got for x in g), np.uint32, int(sizes.sum())), sizes)
        if pc.any(pc.match_substring(texts, SPACE)).as_py():  # the marker itself means a space
            data, offsets = textbuf.buffers(pc.replace_substring(texts, SPACE, " "))
        # the dummy prefix: a space before every text that has any characters
        size = np.diff(offsets)
        if len(size) == 1:
            return self.units.run(np.append(np.uint8(0x20), data), np.array([0, len(data) + 1])) if len(data) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        some = size > 0
        wide = np.full(len(data) + int(some.sum()), 0x20, np.uint8)
        shift = np.cumsum(some)
        wide[np.arange(len(data)) + np.repeat(shift, size)] = data
        return self.units.run(wide, np.concatenate([[0], np.cumsum(size + some)]))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The text of each run of ids, as UTF-8, without the dummy prefix."""
        length = np.diff(self.spelled_ends)[ids]
        parts = range(0, len(ids), DECODED_IDS)
        raw = b"".join(self.spelled[textbuf.ragged(self.spelled_ends[ids[lo : lo + DECODED_IDS]], length[lo : lo + DECODED_IDS])].tobytes() for lo in parts)
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        drop = self.model.add_dummy_prefix and self.model.escape_whitespaces
        return [raw[a + (drop and raw[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _judge(path: str, prefix: bool):
    """The SentencePiece processor of the model; without ``prefix`` its dummy prefix is switched off, by a
    normaliser message behind the model's own that holds field 3, add_dummy_prefix, as false."""
    import sentencepiece

    with open(path, "rb") as f:
        proto = f.read()
    return sentencepiece.SentencePieceProcessor(model_proto=proto if prefix else proto + b"\x1a\x02\x18\x00")


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Before each space that follows something else, and on both sides of each line end."""
    space, line = data == 0x20, data == 0x0A
    cut = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    return np.flatnonzero(cut) + 1


def _simple(unit: bytes) -> bool:
    """One space, at the start: such units join without changing their ids."""
    return unit[0] == 0x20 and len(unit) > 1 and unit.count(b" ") == 1 and b"\n" not in unit


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def parity(path: str, texts: list[str]) -> list[str]:
    """The texts whose ids or decoded text differ from the SentencePiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    ours = Codec(path, verified=False)
    ids, sizes = ours.encode(pa.array(texts, pa.large_string()))
    back = ours.decode(ids, sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, t in enumerate(texts):
        own, want = ids[ends[i] : ends[i + 1]].tolist(), theirs.encode(t)
        if own != want or back[i].decode() != theirs.decode(want):
            out.append(t)
    return out


def _encoder(path: str, passed: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in textbuf.blocks(batches, limit=BLOCK_BYTES):
            texts = b.column("text")
            ids, sizes = own.encode(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            back = own.decode(ids, sizes)
            raw, off = textbuf.buffers(texts)
            raw = raw.tobytes()
            cols = {c: b.column(c) for c in passed}
            cols["n_ids"] = pa.array(sizes, pa.int64())
            cols["round_trip"] = pa.array([x == raw[lo:hi] for x, lo, hi in zip(back, off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.bool_())
            if digest:
                view = memoryview(ids.astype("<u4").tobytes())
                cols["ids_crc32"] = pa.array([zlib.crc32(view[4 * lo : 4 * hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
            else:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def encoded(documents: DataFrame, path: str | None = None, *, digest: bool = False) -> DataFrame:
    """doc_id, the number of ids, whether decoding gives the text back, and the ids (or their CRC-32)."""
    path = path or model_path()
    rows = documents.select("doc_id", F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return textbuf.small_batches(rows).mapInArrow(_encoder(path, ["doc_id"], digest), f"doc_id {kind}, n_ids long, round_trip boolean, " + ("ids_crc32 long" if digest else "ids array<int>"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
