"""Planes of pixels: PackBits, zip, horizontal prediction.

A control byte of 128 does nothing; an unknown compression gives a plane of 255.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

RAW, RLE, ZIP, ZIP_PREDICTED = 0, 1, 2, 3


def unpack_row(data: bytes, width: int) -> bytes:
    out, k = bytearray(), 0
    while k < len(data) and len(out) < width:
        c = data[k]
        k += 1
        if c < 128:
            out += data[k : k + c + 1]
            k += c + 1
        elif c > 128:
            out += data[k : k + 1] * (257 - c)
            k += 1
    return bytes(out[:width].ljust(width, b"\0"))


def pack_row(row: bytes) -> bytes:
    """Runs of two and more as runs, all else as literals, 128 bytes at most each."""
    a = np.frombuffer(row, dtype=np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = [0, *edges.tolist()]
    ends = [*edges.tolist(), len(a)]
    out, lit = bytearray(), -1

    def literals(until: int) -> None:
        nonlocal lit
        for k in range(lit, until, 128):
            part = row[k : min(until, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)
        lit = -1

    for s, e in zip(starts, ends):
        if e - s == 1:
            lit = s if lit < 0 else lit
            continue
        if lit >= 0:
            literals(s)
        k = s
        while e - k > 1:
            n = min(128, e - k)
            out += bytes((257 - n, row[k]))
            k += n
        if e - k == 1:
            lit = k
    if lit >= 0:
        literals(len(row))
    return bytes(out)


def pack_plane(plane: bytes, width: int, height: int, sample: int = 1) -> bytes:
    """A plane as row lengths followed by packed rows."""
    w = width * sample
    made: dict[bytes, bytes] = {}  # rows of one colour and empty rows come many times
    rows = []
    for k in range(height):
        row = bytes(plane[k * w : (k + 1) * w])
        packed = made.get(row)
        if packed is None:
            packed = made[row] = pack_row(row)
        rows.append(packed)
    return struct.pack(f">{height}H", *map(len, rows)) + b"".join(rows)


def unpack_rows(data: bytes, lengths: list[int], width: int) -> bytes:
    out, at = [], 0
    made: dict[bytes, bytes] = {}
    for n in lengths:
        row = bytes(data[at : at + n])
        plain = made.get(row)
        if plain is None:
            plain = made[row] = unpack_row(row, width)
        out.append(plain)
        at += n
    return b"".join(out)


def row_bytes(width: int, depth: int) -> int:
    return (width + 7) // 8 if depth == 1 else width * depth // 8


def undo_prediction(data: bytes, width: int, height: int, depth: int) -> bytes:
    if depth == 8:
        return np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(height, width), axis=1, dtype=np.uint8).tobytes()
    if depth == 16:
        return np.cumsum(np.frombuffer(data, dtype=">u2").astype(np.uint16).reshape(height, width), axis=1, dtype=np.uint16).astype(">u2").tobytes()
    # 32-bit floats: each row is split into its four byte planes, predicted over all of them
    planes = np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(height, 4 * width), axis=1, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(height, 4, width).transpose(0, 2, 1)).tobytes()


def predict(data: bytes, width: int, height: int, depth: int) -> bytes:
    if depth == 8:
        a = np.frombuffer(data, dtype=np.uint8).reshape(height, width)
        return np.diff(a, axis=1, prepend=np.zeros((height, 1), np.uint8)).astype(np.uint8).tobytes()
    if depth == 16:
        a = np.frombuffer(data, dtype=">u2").astype(np.uint16).reshape(height, width)
        return np.diff(a, axis=1, prepend=np.zeros((height, 1), np.uint16)).astype(">u2").tobytes()
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4).transpose(0, 2, 1).reshape(height, 4 * width)
    return np.diff(a, axis=1, prepend=np.zeros((height, 1), np.uint8)).astype(np.uint8).tobytes()


def decode_plane(compression: int, data: bytes, width: int, height: int, depth: int) -> bytes:
    n = row_bytes(width, depth)
    if compression == RAW:
        return data[: n * height].ljust(n * height, b"\0")
    if compression == RLE:
        lengths = list(struct.unpack(f">{height}H", data[: 2 * height]))
        return unpack_rows(data[2 * height :], lengths, n)
    if compression in (ZIP, ZIP_PREDICTED):
        plain = zlib.decompressobj().decompress(data)[: n * height].ljust(n * height, b"\0")
        return undo_prediction(plain, width, height, depth) if compression == ZIP_PREDICTED and depth > 1 else plain
    return b"\xff" * (n * height)


def encode_plane(compression: int, plane: bytes, width: int, height: int, depth: int) -> bytes:
    if compression == RLE:
        return pack_plane(plane, row_bytes(width, depth), height)
    if compression == ZIP:
        return zlib.compress(plane)
    if compression == ZIP_PREDICTED:
        return zlib.compress(predict(plane, width, height, depth))
    return plane


def composite_planes(data: bytes, channels: int, width: int, height: int, depth: int) -> list[bytes]:
    """The planes of the merged image: one row table for all channels, one zip stream for all planes."""
    n, compression, body = row_bytes(width, depth), struct.unpack(">H", data[:2])[0], data[2:]
    if compression == RLE:
        lengths = struct.unpack(f">{channels * height}H", body[: 2 * channels * height])
        at, out = 2 * channels * height, []
        for c in range(channels):
            own = list(lengths[c * height : (c + 1) * height])
            out.append(unpack_rows(body[at : at + sum(own)], own, n))
            at += sum(own)
        return out
    if compression in (ZIP, ZIP_PREDICTED):
        body = zlib.decompressobj().decompress(body)
    planes = [body[c * n * height : (c + 1) * n * height].ljust(n * height, b"\0") for c in range(channels)]
    return [undo_prediction(p, width, height, depth) for p in planes] if compression == ZIP_PREDICTED and depth > 1 else planes


def solid_composite(colors: list[int], width: int, height: int) -> bytes:
    """A merged image of one colour: each channel packs one row, which all its rows share."""
    rows = [pack_row(bytes((c,)) * width) for c in colors]
    lengths = b"".join(struct.pack(">H", len(r)) * height for r in rows)
    return struct.pack(">H", RLE) + lengths + b"".join(r * height for r in rows)
