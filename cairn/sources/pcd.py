"""Point cloud files in the PCD format (ascii, binary, binary_compressed) as a Spark data source, ``format("pcd")``.

Reading: a path is a file, or a folder of ``.pcd`` files; each file is a partition, and only the
wanted columns of the schema leave it.  Writing: one binary file per partition, from Arrow batches.
Paths go through pyarrow's file systems, so they may be URIs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Codes of the header's TYPE line, with sizes (fixed values of the format).
_KINDS = {"F": "f", "I": "i", "U": "u"}


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def parse(data: bytes) -> np.ndarray:
    """The records of a PCD file as a structured array, counts over 1 as sub-arrays."""
    header: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in header:
        end = data.index(b"\n", at)
        line = data[at:end].decode("ascii", "replace").split("#")[0].split()
        at = end + 1
        if line:
            header[line[0].upper()] = line[1:]
    names = header["FIELDS"]
    sizes, kinds = header["SIZE"], header["TYPE"]
    counts = [int(c) for c in header.get("COUNT", ["1"] * len(names))]
    kind = np.dtype([(n, f"<{_KINDS[k]}{s}", (c,)) if c > 1 else (n, f"<{_KINDS[k]}{s}") for n, s, k, c in zip(names, sizes, kinds, counts, strict=True)])
    n = int(header["POINTS"][0]) if "POINTS" in header else int(header["WIDTH"][0]) * int(header.get("HEIGHT", ["1"])[0])
    mode = header["DATA"][0].lower()
    if mode == "binary":
        return np.frombuffer(data, kind, n, at)
    if mode == "binary_compressed":  # two sizes, then all values of the first field, of the second, ...
        packed, size = (int(x) for x in np.frombuffer(data, "<u4", 2, at))
        plain, lo, out = unpacked(data[at + 8 : at + 8 + packed], size), 0, np.empty(n, kind)
        for name in names:
            out[name] = np.frombuffer(plain, kind[name].base, n * (kind[name].shape or (1,))[0], lo).reshape(out[name].shape)
            lo += n * kind[name].itemsize
        return out
    if mode != "ascii":
        raise ValueError(f"{mode} data are not supported")
    if max(counts, default=1) > 1:
        raise ValueError("ascii fields of several values are not supported")
    words = np.array(data[at:].split())
    if len(words) < n * len(names):
        raise ValueError(f"{len(words) // max(1, len(names))} of {n} points")
    out = np.empty(n, kind)
    for name, column in zip(names, words[: n * len(names)].reshape(n, len(names)).T, strict=True):
        out[name] = column.astype(np.float64 if kind[name].kind == "f" else np.int64)
    return out


def unpacked(data: bytes, size: int) -> bytes:
    """LZF: a byte under 32 says how many literal bytes, less one, follow; any other is a reference to earlier output,
    with three bits of its length, less two (all set: a further byte adds to them), and 13 bits of its distance, less one."""
    out, i = bytearray(), 0
    while i < len(data):
        head, i = data[i], i + 1
        if head < 32:
            out += data[i : i + head + 1]
            i += head + 1
            continue
        n = (head >> 5) + 2
        if n == 9:
            n, i = n + data[i], i + 1
        start, i = len(out) - ((head & 31) << 8 | data[i]) - 1, i + 1
        if start < 0:
            raise ValueError("a reference before the beginning")
        while n > 0:  # a reference may run into what it writes
            piece = out[start : start + n]
            out += piece
            start, n = start + len(piece), n - len(piece)
    if len(out) != size:
        raise ValueError(f"{len(out)} of {size} bytes")
    return bytes(out)


def render(columns: dict[str, np.ndarray]) -> bytes:
    """A binary PCD file of float64 and int32 or int64 columns."""
    n = len(next(iter(columns.values()))) if columns else 0
    kind = np.dtype([(k, "<f8" if v.dtype.kind == "f" else "<i8" if v.dtype.itemsize == 8 else "<i4") for k, v in columns.items()])
    body = np.empty(n, kind)
    for k, v in columns.items():
        body[k] = v
    fields = list(columns)
    lines = [
        "VERSION .7",
        "FIELDS " + " ".join(fields),
        "SIZE " + " ".join(str(kind[k].itemsize) for k in fields),
        "TYPE " + " ".join("F" if kind[k].kind == "f" else "I" for k in fields),
        "COUNT " + " ".join("1" for _ in fields),
        f"WIDTH {n}",
        "HEIGHT 1",
        "VIEWPOINT 0 0 0 1 0 0 0",
        f"POINTS {n}",
        "DATA binary",
    ]
    return ("\n".join(lines) + "\n").encode() + body.tobytes()


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, root = _open(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [_File(root)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".pcd")] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        with system.open_input_stream(partition.path) as f:
            points = parse(f.read())
        columns = {}
        for field in self.schema.fields:
            if field.name == "path":
                columns["path"] = pa.array([partition.path] * len(points), pa.string())
            elif field.name == "point_id" and "point_id" not in points.dtype.names:
                columns["point_id"] = pa.array(np.arange(len(points)), pa.int64())
            elif field.dataType.simpleString() in ("double", "float"):
                columns[field.name] = pa.array(points[field.name].astype(np.float64 if field.dataType.simpleString() == "double" else np.float32))
            else:
                columns[field.name] = pa.array(points[field.name].astype(np.int64 if field.dataType.simpleString() == "bigint" else np.int32))
        yield pa.RecordBatch.from_pydict(columns)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        kinds = {f.name: np.float64 if f.dataType.simpleString() in ("double", "float") else np.int64 if f.dataType.simpleString() == "bigint" else np.int32 for f in self.schema.fields}
        got = [b for b in batches if b.num_rows]
        columns = {f.name: np.concatenate([b.column(i).to_numpy(zero_copy_only=False).astype(kinds[f.name]) for b in got] or [np.zeros(0, kinds[f.name])]) for i, f in enumerate(self.schema.fields)}
        system, root = _open(self.path)
        system.create_dir(root)
        part = TaskContext.get().partitionId()
        out = _Written(f"{root}/.{part:05d}-{uuid.uuid4().hex}", f"{root}/part-{part:05d}.pcd" if got else "")
        with system.open_output_stream(out.temporary) as f:
            f.write(render(columns))
        return out

    def commit(self, messages: list[_Written]) -> None:
        """Only now do the files get names that readers look at."""
        from pyarrow import fs

        system, root = _open(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.path.endswith(".pcd"):
                    system.delete_file(f.path)
        for m in messages:
            if m and m.final:
                system.move(m.temporary, m.final)
            elif m:
                system.delete_file(m.temporary)

    def abort(self, messages: list[_Written]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(m.temporary)


class PcdDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return "path string, point_id bigint, x double, y double, z double"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcdDataSource)
