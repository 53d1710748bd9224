"""Bounded big-endian reading and writing of document bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable


class Short(ValueError):
    """The bytes end before a field does."""


class Ranged:
    """Bytes of a file that are read where they are asked for: ``read_at(n, offset)``, one block of ``block`` bytes kept.

    ``fetched`` counts the bytes read.
    """

    def __init__(self, read_at: Callable[[int, int], bytes], size: int, block: int = 1 << 16):
        self.read_at, self.size, self.block = read_at, size, block
        self.at, self.held, self.fetched = 0, b"", 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if a < self.at or b > self.at + len(self.held):
            self.at, self.held = a, self.read_at(max(b - a, min(self.block, self.size - a)), a)
            self.fetched += len(self.held)
        return self.held[a - self.at : b - self.at]


class Reader:
    """A cursor over a slice; sub-readers can't leave their slice."""

    __slots__ = ("data", "end", "pos")

    def __init__(self, data: bytes | memoryview | Ranged, pos: int = 0, end: int | None = None):
        self.data, self.pos, self.end = data if isinstance(data, Ranged) else memoryview(data), pos, len(data) if end is None else end

    def left(self) -> int:
        return self.end - self.pos

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.end - self.pos:
            raise Short(f"{n} bytes wanted at {self.pos}, {self.end - self.pos} there")
        self.pos += n
        return bytes(self.data[self.pos - n : self.pos])

    def skip(self, n: int) -> None:
        if n < 0 or n > self.end - self.pos:
            raise Short(f"block of {n} bytes at {self.pos}, {self.end - self.pos} there")
        self.pos += n

    def fields(self, form: struct.Struct) -> tuple:
        """Several fields at once."""
        n = form.size
        if self.pos + n <= self.end and type(self.data) is memoryview:
            self.pos += n
            return form.unpack_from(self.data, self.pos - n)
        return form.unpack(self.take(n))

    def sub(self, n: int) -> Reader:
        if n < 0 or n > self.end - self.pos:
            raise Short(f"block of {n} bytes at {self.pos}, {self.end - self.pos} there")
        self.pos += n
        return Reader(self.data, self.pos - n, self.pos)

    def rest(self) -> bytes:
        return self.take(self.left())

    def _one(self, form: str, n: int):
        if self.pos + n <= self.end and type(self.data) is memoryview:
            self.pos += n
            return struct.unpack_from(form, self.data, self.pos - n)[0]
        return struct.unpack(form, self.take(n))[0]

    def u8(self) -> int:
        return self._one(">B", 1)

    def i16(self) -> int:
        return self._one(">h", 2)

    def u16(self) -> int:
        return self._one(">H", 2)

    def i32(self) -> int:
        return self._one(">i", 4)

    def u32(self) -> int:
        return self._one(">I", 4)

    def i64(self) -> int:
        return self._one(">q", 8)

    def f64(self) -> float:
        return self._one(">d", 8)

    def key(self) -> str:
        return self.take(4).decode("latin-1")

    def pascal(self, align: int) -> bytes:
        n = self.u8()
        name = self.take(n)
        self.skip(min(-(n + 1) % align, self.left()))
        return name

    def unicode(self) -> str:
        return utf16(self.take(2 * self.u32()))


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace").removesuffix("\x00")


class Writer:
    """Appends fields; ``block`` writes a size in front of what is written inside it."""

    def __init__(self):
        self.out = bytearray()

    def put(self, form: str, *values) -> Writer:
        self.out += struct.pack(">" + form, *values)
        return self

    def raw(self, data: bytes | str) -> Writer:
        self.out += data.encode("latin-1") if isinstance(data, str) else data
        return self

    def pad(self, align: int, start: int = 0) -> Writer:
        self.out += b"\0" * (-(len(self.out) - start) % align)
        return self

    def pascal(self, name: bytes, align: int) -> Writer:
        start = len(self.out)
        return self.put("B", len(name[:255])).raw(name[:255]).pad(align, start)

    def unicode(self, text: str, nul: bool = True) -> Writer:
        raw = (text + "\0" * nul).encode("utf-16-be")
        return self.put("I", len(raw) // 2).raw(raw)

    def block(self, data: bytes, form: str = "I") -> Writer:
        return self.put(form, len(data)).raw(data)

    def bytes(self) -> bytes:
        return bytes(self.out)
