"""Variable-length and fixed integers of the format."""

from __future__ import annotations

import struct

from .errors import BlockError


def read_u30(data: bytes, at: int) -> tuple[int, int]:
    """Little-endian groups of 7 bits, at most five bytes; the value isn't masked."""
    if at < len(data) and data[at] < 0x80:  # most numbers are one byte
        return data[at], at + 1
    value = 0
    for k in range(5):
        if at >= len(data):
            raise BlockError(f"integer cut off at {at}")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            break
    return value, at


def read_s32(data: bytes, at: int) -> tuple[int, int]:
    """As `read_u30`, with the sign taken from the last group unless all five bytes are there."""
    start = at
    value, at = read_u30(data, at)
    width = 7 * (at - start)
    if width < 32 and data[at - 1] & 0x40:
        value -= 1 << width
    return value, at


SMALL = tuple(bytes([value]) for value in range(0x80))


def write_u30(value: int) -> bytes:
    if 0 <= value < 0x80:
        return SMALL[value]
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def write_s32(value: int) -> bytes:
    """The shortest form; negative numbers of more than 28 bits take five bytes of their 32 bits."""
    for n in range(1, 5):
        if -(1 << (7 * n - 1)) <= value < 1 << (7 * n - 1):
            bits = value & ((1 << (7 * n)) - 1)
            return bytes((bits >> (7 * k)) & 0x7F | (0x80 if k < n - 1 else 0) for k in range(n))
    return write_u30(value & 0xFFFFFFFF)


def read_s24(data: bytes, at: int) -> tuple[int, int]:
    if at + 3 > len(data):
        raise BlockError(f"integer cut off at {at}")
    return int.from_bytes(data[at : at + 3], "little", signed=True), at + 3


def write_s24(value: int) -> bytes:
    return (value & 0xFFFFFF).to_bytes(3, "little")


def read_d64(data: bytes, at: int) -> tuple[float, int]:
    if at + 8 > len(data):
        raise BlockError(f"double cut off at {at}")
    return struct.unpack_from("<d", data, at)[0], at + 8
