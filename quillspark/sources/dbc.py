"""Compressed dBase files (R10): a dBase header, four bytes of checksum, then the records in the imploded form of the PKWARE data compression library.

Fixed values below are those of the public format: code lengths packed as (repeat - 1) * 16 + length.
"""

from __future__ import annotations

import struct

from ..errors import DecodeFailed

LITERALS = [11, 124, 8, 7, 28, 7, 188, 13, 76, 4, 10, 8, 12, 10, 12, 10, 8, 23, 8, 9, 7, 6, 7, 8, 7, 6, 55, 8, 23, 24, 12, 11, 7, 9, 11, 12, 6, 7, 22, 5, 7, 24, 6, 11, 9, 6, 7, 22, 7, 11, 38, 7, 9, 8, 25, 11, 8, 11, 9, 12, 8, 12, 5, 38, 5, 38, 5, 11, 7, 5, 6, 21, 6, 10, 53, 8, 7, 24, 10, 27, 44, 253, 253, 253, 252, 252, 252, 13, 12, 45, 12, 45, 12, 61, 12, 45, 44, 173]
LENGTHS = [2, 35, 36, 53, 38, 23]
DISTANCES = [2, 20, 53, 230, 247, 151, 248]
BASE = [3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264]
EXTRA = [0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
END = 519
#: An unpacked file may be so many times as large as the packed one; more is refused.
MOST = 1000


def codes(packed: list[int]) -> dict[tuple[int, int], int]:
    """Symbols by (bits, code), of a canonical code whose bits are stored inverted."""
    sizes = [x & 15 for x in packed for _ in range((x >> 4) + 1)]
    out, code = {}, 0
    for n in range(1, max(sizes) + 1):
        code <<= 1
        for symbol, size in enumerate(sizes):
            if size == n:
                out[n, code] = symbol
                code += 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise DecodeFailed("compressed data ends early")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8
        out = self.held & ((1 << n) - 1)
        self.held >>= n
        self.n -= n
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 16):
            code = code << 1 | (self.take(1) ^ 1)
            if (found := table.get((n, code))) is not None:
                return found
        raise DecodeFailed("no such code in compressed data")


def explode(data: bytes) -> bytes:
    """The bytes that an imploded stream stands for."""
    bits = _Bits(data)
    coded, width = bits.take(8), bits.take(8)
    if coded > 1 or not 4 <= width <= 6:
        raise DecodeFailed("not an imploded stream")
    literals, lengths, distances = codes(LITERALS), codes(LENGTHS), codes(DISTANCES)
    out = bytearray()
    while True:
        if len(out) > MOST * len(data) + 1024:
            raise DecodeFailed("unpacked data are too large")
        if not bits.take(1):
            out.append(bits.symbol(literals) if coded else bits.take(8))
            continue
        s = bits.symbol(lengths)
        n = BASE[s] + bits.take(EXTRA[s])
        if n == END:
            return bytes(out)
        low = 2 if n == 2 else width
        back = (bits.symbol(distances) << low) + bits.take(low) + 1
        if back > len(out):
            raise DecodeFailed("compressed data point before their start")
        for _ in range(n):
            out.append(out[-back])


def implode(data: bytes) -> bytes:
    """A stream of plain literals, which every reader of the format takes."""
    held, n, out = 0, 0, bytearray([0, 4])
    (size, code) = next(k for k, v in codes(LENGTHS).items() if v == 15)
    end = [1, *((code >> i & 1) ^ 1 for i in range(size - 1, -1, -1)), *[1] * 8]
    for bit in (b for x in data for b in (0, *((x >> i) & 1 for i in range(8)))):
        held |= bit << n
        n += 1
        if n == 8:
            out.append(held)
            held, n = 0, 0
    for bit in end:
        held |= bit << n
        n += 1
        if n == 8:
            out.append(held)
            held, n = 0, 0
    return bytes(out) + (bytes([held]) if n else b"")


def unpack(data: bytes) -> bytes:
    """The dBase file in a compressed one."""
    if len(data) < 16:
        raise DecodeFailed("too short for a compressed dBase file")
    (head,) = struct.unpack("<H", data[8:10])
    return data[:head] + explode(data[head + 4 :])


def pack(data: bytes) -> bytes:
    (head,) = struct.unpack("<H", data[8:10])
    return data[:head] + b"\0\0\0\0" + implode(data[head:])
