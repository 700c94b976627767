"""Token-id output: raw id payloads behind a minimal perfect hash index.

Documents are sorted by id into range shards, encoded, and each shard is one file::

    payload   ids, little-endian unsigned, 2 bytes each if the vocabulary allows, else 4
    ends      uint64[n + 1]   first id of each document, in ascending id order
    keys      int64[n]        document ids (the first ``nulls`` of them stand for null)
    levels    the minimal perfect hash: bit words and ranks of each level
    slots     uint32[m] row of the slot's key, uint32[m] fingerprint of the key
    footer    JSON with the sections' places, its length (uint64) and a magic word

The index maps a key to its slot in constant time: at each level the key has one bit; the
first set bit's rank is the slot, and the stored 32-bit fingerprint rejects foreign keys
(one in 2**32 passes).  Keys that repeat are adjacent; the slot has the first row.

Beside the shards lies ``manifest.parquet`` with each shard's place in the output and its first and last
key.  ``Store(folder).get(key)`` looks the key's shard up in it, opens that one, and asks its index: the cost
does not depend on the number of documents.

Scale: one shuffle of the texts, by range of the id; a task holds one block of texts and one
shard's id table, never its payload.  Files are written under a temporary name and renamed, and
their content depends on the rows alone, so a retried or doubled task leaves the same file.

Edge cases: a null or empty text holds only the end id; null document ids come first and are
not in the index; repeated ids keep all their rows, in any one order and, if they are very many, in several
shards, of which ``get`` finds the first; rows that agree in id and text stay in one shard; an empty
table writes a manifest without rows; a very long text is a block of its own (about 8 times its
bytes); extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import storage
from . import op7_tokens, ranges, textbuf
from .units import UnitEncoder, joined

END_ID = 2
MAGIC = b"cairnid1"
ROWS_PER_SHARD = 4096
BLOCK_BYTES = 4 << 20
KEPT_UNITS = 500_000
GAMMA = 2.0
LEVELS = 40


def _level_positions(hashed: np.ndarray, level: int, size: int) -> np.ndarray:
    return (textbuf.mix(hashed + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & ((1 << 64) - 1))) % np.uint64(size)).astype(np.int64)


def _hash_keys(keys: np.ndarray) -> np.ndarray:
    return textbuf.mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (textbuf.mix(_hash_keys(keys) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys: levels of bits without collisions."""

    def __init__(self, sizes: list[int], words: list[np.ndarray], ranks: list[np.ndarray]):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words, ranks, before = _hash_keys(keys), [], [], [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _level_positions(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(bits).astype(np.int64)
            sizes.append(size)
            words.append(bits)
            ranks.append((before + np.cumsum(counts) - counts).astype(np.uint32))
            before += int(counts.sum())
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys must be distinct")
        return cls(sizes, words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level knows it."""
        hashed = _hash_keys(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _level_positions(hashed[todo], level, size)
            word, bit = self.words[level][at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = self.ranks[level][at[hit] >> 6].astype(np.int64) + below[hit]
            todo = todo[~hit]
        return out


def _file_system(path: str):
    """(file system, path in it) of a URI."""
    from pyarrow import fs

    if ":" not in path:
        raise ValueError(f"{path} names no file system; give a URI such as file://, hdfs:// or s3://")
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI; one without a scheme lies in Hadoop's default file system, as for Spark itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


class ShardWriter:
    def __init__(self, folder: str, name: str, width: int):
        self.fs, root = _file_system(folder)
        self.fs.create_dir(root)
        self.final, self.temporary, self.width = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}", width
        self.out = self.fs.open_output_stream(self.temporary)
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.nulls = 0

    def add(self, keys: np.ndarray, nulls: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.keys.append(keys)
        self.lengths.append(lengths)
        self.nulls += nulls

    def close(self) -> tuple[int, int, int | None, int | None]:
        """(documents, ids, first key, last key) written."""
        keys = np.concatenate(self.keys)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))]).astype("<u8")
        own = keys[self.nulls :]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
        distinct = own[first]
        index = PerfectHash.build(distinct)
        slots = index.slots(distinct)
        rows = np.zeros(len(distinct), "<u4")
        marks = np.zeros(len(distinct), "<u4")
        rows[slots] = first + self.nulls
        marks[slots] = fingerprints(distinct)
        at = int(ends[-1]) * self.width
        footer = {"width": self.width, "nulls": self.nulls, "docs": len(keys), "ids": int(ends[-1]), "slots": len(distinct), "sizes": index.sizes, "at": {}}
        for name, array in [("ends", ends), ("keys", keys.astype("<i8")), *((f"words{i}", w) for i, w in enumerate(index.words)), *((f"ranks{i}", r) for i, r in enumerate(index.ranks)), ("rows", rows), ("marks", marks)]:
            raw = array.tobytes()
            self.out.write(raw)
            footer["at"][name] = [at, len(raw), array.dtype.str]
            at += len(raw)
        tail = json.dumps(footer).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return len(keys), int(ends[-1]), *((int(own[0]), int(own[-1])) if len(own) else (None, None))


class ShardReader:
    def __init__(self, folder: str, name: str):
        fs, root = _file_system(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a shard")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.keys, self.ends = self._section("keys"), self._section("ends").astype(np.int64)
        levels = range(len(self.footer["sizes"]))
        self.index = PerfectHash(self.footer["sizes"], [self._section(f"words{i}") for i in levels], [self._section(f"ranks{i}") for i in levels])
        self.rows, self.marks = self._section("rows").astype(np.int64), self._section("marks")

    def _section(self, name: str) -> np.ndarray:
        at, n, kind = self.footer["at"][name]
        return np.frombuffer(self.file.read_at(n, at), kind)

    def row_of(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 for keys that the shard does not hold."""
        if not self.footer["slots"]:
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slots(keys)
        known = (slots >= 0) & (self.marks[np.maximum(slots, 0)] == fingerprints(keys))
        return np.where(known, self.rows[np.maximum(slots, 0)], -1)

    def ids(self, row: int) -> np.ndarray:
        return self.span(row, row + 1)

    def span(self, first: int, last: int) -> np.ndarray:
        """The ids of rows first .. last - 1, as little-endian unsigned 32-bit integers."""
        width = self.footer["width"]
        a, b = int(self.ends[first]), int(self.ends[last])
        return np.frombuffer(self.file.read_at((b - a) * width, a * width), f"<u{width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of one document by its key."""
        row = int(self.row_of(np.array([key], np.int64))[0])
        return None if row < 0 else self.ids(row)

    def close(self) -> None:
        self.file.close()


class Store:
    """Keyed access to a whole output by its manifest; shards are opened as they are asked for."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        self.folder = folder
        fs, root = _file_system(folder)
        self.manifest = pq.read_table(f"{root}/{MANIFEST}", filesystem=fs)
        keyed = self.manifest.filter(pa.compute.is_valid(self.manifest.column("first_key")))
        self.shard, self.low, self.high = (keyed.column(c).to_numpy() for c in ("shard", "first_key", "last_key"))
        self.open: dict[int, ShardReader] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of that key, None if there is none."""
        at = int(np.searchsorted(self.high, key))
        if at == len(self.high) or self.low[at] > key:
            return None
        number = int(self.shard[at])
        if number not in self.open:
            self.open[number] = ShardReader(self.folder, shard_name(number))
        return self.open[number].get(key)

    def close(self) -> None:
        for reader in self.open.values():
            reader.close()
        self.open.clear()


_encoders: dict[str, UnitEncoder] = {}
#: How byte-level vocabularies write the space byte.
_SPACE = "\u0120"


def _simple(unit: bytes) -> bool:
    """One space, at the start, and a visible character at the end: such units join at safe boundaries."""
    return unit[0] == 0x20 and unit.count(b" ") == 1 and (0x20 < unit[-1] < 0x7F or unit[-2:-1] == b"\xc3")


def unit_encoder(path: str) -> UnitEncoder:
    """The process's encoder of a byte-level tokenizer file, by distinct units."""
    if path not in _encoders:
        tokenizer = op7_tokens.load(path)
        starts = np.zeros(tokenizer.get_vocab_size(), bool)
        starts[[i for token, i in tokenizer.get_vocab().items() if token.startswith(_SPACE)]] = True
        _encoders[path] = UnitEncoder(lambda units: joined(tokenizer, starts, units, _simple), op7_tokens.safe_cuts, KEPT_UNITS)
    return _encoders[path]


MANIFEST = "manifest.parquet"


def shard_name(number: int) -> str:
    return f"shard-{number:07d}.ids"


def _writer(folder: str, path: str, end_id: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(path)
        writer, current = None, None

        def finished() -> pa.RecordBatch:
            numbers = dict(zip(("docs", "ids", "first_key", "last_key"), writer.close(), strict=True))
            return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int32()), **{k: pa.array([v], pa.int64()) for k, v in numbers.items()}})

        for b in textbuf.blocks(batches, limit=BLOCK_BYTES):
            shards = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if shards[lo] != current:
                    if writer:
                        yield finished()
                    current = int(shards[lo])
                    writer = ShardWriter(folder, shard_name(current), width)
                ids, lengths = encoder.run(*textbuf.buffers(part.column("text")))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
                    lengths = lengths + 1
                key = part.column("doc_id")
                writer.add(key.fill_null(0).to_numpy(), key.null_count, ids, lengths)
        if writer:
            yield finished()

    return run


def write(spark: SparkSession, documents: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int | None = END_ID, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Write the shards of the documents; returns, and keeps beside them, the manifest: shard, docs, ids, first_key,
    last_key and first_id, the number of ids in the shards before."""
    folder = qualified(spark, folder)
    path = tokenizer or op7_tokens.tokenizer_path()
    width = 2 if op7_tokens.load(path).get_vocab_size() <= 1 << 16 else 4
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = ranges.bounds(rows, "doc_id", rows_per_shard)
    rows = rows.withColumn("place", F.xxhash64("text"))
    placed = rows.withColumn("shard", ranges.bucket(F.col("doc_id"), F.col("place"), ends).cast("int"))
    sorted_rows = placed.repartitionById(len(ends) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "place", "text")
    manifest = storage.stored(textbuf.small_batches(sorted_rows).mapInArrow(_writer(folder, path, end_id, width), "shard int, docs long, ids long, first_key long, last_key long"), "manifest")
    # one small row per file: numbering them in one task, and bringing them here, is bounded by the number of files
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("first_id", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    _keep(folder, manifest.orderBy("shard").toArrow())
    return manifest


def _keep(folder: str, manifest: pa.Table) -> None:
    import pyarrow.parquet as pq

    fs, root = _file_system(folder)
    fs.create_dir(root)
    temporary = f"{root}/.{MANIFEST}-{uuid.uuid4().hex}"
    pq.write_table(manifest, temporary, filesystem=fs)
    fs.move(temporary, f"{root}/{MANIFEST}")


READ_IDS = 1 << 20


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files, found by key."""
    folder = qualified(manifest.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first in zip(b.column("shard").to_pylist(), b.column("first_id").to_pylist(), strict=True):
                reader = ShardReader(folder, shard_name(shard))
                nulls, n = reader.footer["nulls"], reader.footer["docs"]
                keys = reader.keys
                found = reader.row_of(keys[nulls:])
                if (found < 0).any() or (keys[found] != keys[nulls:]).any():
                    raise ValueError(f"the index of shard {shard} misses keys")
                lengths = np.diff(reader.ends)
                # repeats of a key follow its first row
                own = keys[nulls:]
                begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
                repeat = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
                rows = np.concatenate([np.arange(nulls), found + repeat])
                crc = np.zeros(n, np.int64)
                lo = 0
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(reader.ends, reader.ends[lo] + READ_IDS, "right")) - 1)
                    hi = min(hi, n)
                    raw = memoryview(reader.span(lo, hi).tobytes())
                    at = (reader.ends[lo : hi + 1] - reader.ends[lo]) * 4
                    for i in range(hi - lo):
                        crc[lo + i] = zlib.crc32(raw[at[i] : at[i + 1]])
                    lo = hi
                reader.close()
                null = np.arange(n) < nulls
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(keys, mask=null), "start": pa.array(first + reader.ends[rows]), "n_tokens": pa.array(lengths[rows]), "ids_crc32": pa.array(crc[rows])}
                )

    # one task a shard: adaptive execution would put the few small rows of the manifest together
    tasks = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    return manifest.repartitionById(tasks, F.col("shard")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{storage.shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(spark, docs, folder), folder)
