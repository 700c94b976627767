"""A reader for SentencePiece model files: the protobuf wire format, decoded by hand."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Piece types of the public model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the public model format (fixed values).
UNIGRAM, BPE = 1, 2
SPACE = "▁"


@dataclass
class SpmModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    normaliser: str = ""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(field number, value) pairs of one message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind} is not in use")
        yield key >> 3, value


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def parse(path: str) -> SpmModel:
    """The parts of a model file that encoding needs."""
    with open(path, "rb") as f:
        data = f.read()
    m = SpmModel()
    for no, value in fields(data):
        if no == 1:
            piece = dict(fields(value))
            m.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif no == 2:
            t = dict(fields(value))
            m.model_type = t.get(3, UNIGRAM)
            m.byte_fallback = bool(t.get(35, 0))
            m.unk_id = _signed(t.get(40, 0))
        elif no == 3:
            t = dict(fields(value))
            m.normaliser = t.get(1, b"").decode()
            m.charsmap = t.get(2, b"")
            m.add_dummy_prefix = bool(t.get(3, 1))
            m.remove_extra_whitespaces = bool(t.get(4, 1))
            m.escape_whitespaces = bool(t.get(5, 1))
    return m
