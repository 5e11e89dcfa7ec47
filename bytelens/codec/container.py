"""SWF and SWZ containers: tags in, tags out."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from ..functions.fixed import TAGS
from .errors import ContainerError

END, SYMBOLS, DO_ABC, DO_ABC2 = 0, 76, 72, 82
#: Most bytes that a compressed container may unpack to.
MOST_BYTES = 1 << 30
VERSION = (16, 46)


@dataclass(slots=True)
class Tag:
    kind: int
    payload: bytes
    name: str = ""

    @property
    def kind_name(self) -> str:
        return TAGS.get(self.kind, f"Unknown({self.kind})")


@dataclass(slots=True)
class Movie:
    header: bytes
    tags: list[Tag]
    version: int
    length: int


def inflate(data: bytes, most: int = MOST_BYTES) -> bytes:
    """zlib with a bound on the size of the output."""
    job = zlib.decompressobj()
    try:
        out = job.decompress(data, most)
    except zlib.error as e:
        raise ContainerError(f"bad compressed data: {e}") from e
    if job.unconsumed_tail:
        raise ContainerError(f"more than {most} bytes unpacked")
    return out


def read_movie(data: bytes) -> Movie:
    """The tags of an SWF; only plain and zlib files."""
    if len(data) < 8:
        raise ContainerError(f"{len(data)} bytes are no SWF")
    signature, version, length = data[:3], data[3], struct.unpack_from("<I", data, 4)[0]
    if signature == b"CWS":
        body = data[:8] + inflate(data[8:])
    elif signature == b"FWS":
        body = data
    else:
        raise ContainerError(f"unknown signature {signature!r}")
    if len(body) < 9:
        raise ContainerError("no header")
    bits = 5 + 4 * (body[8] >> 3)  # a rectangle of four numbers, then frame rate and count
    at = 8 + (bits + 7) // 8 + 4
    header, tags = body[:at], []
    while at < len(body) - 1:
        word = struct.unpack_from("<H", body, at)[0]
        at += 2
        kind, size = word >> 6, word & 0x3F
        if size == 0x3F:
            if at + 4 > len(body):
                break
            size = struct.unpack_from("<I", body, at)[0]
            at += 4
        payload = body[at : at + size]
        at += size
        name = ""
        if kind == DO_ABC2:
            end = payload.find(b"\0", 4)
            if end < 0:
                raise ContainerError("a bytecode tag without a name")
            name = payload[4:end].decode("utf-8", "replace")
        tags.append(Tag(kind, payload, name))
        if kind == END:
            break
    return Movie(header, tags, version, length)


def block_of(tag: Tag) -> bytes | None:
    """The bytecode of a tag, if it has some of more than four bytes."""
    if tag.kind == DO_ABC:
        out = tag.payload
    elif tag.kind == DO_ABC2:
        out = tag.payload[tag.payload.index(b"\0", 4) + 1 :]
    else:
        return None
    return out if len(out) > 4 else None


def read_bundle(data: bytes) -> bytes:
    """The bytecode block of an SWZ: compressed somewhere near its start, or as it is."""
    is_block = lambda b: len(b) >= 4 and struct.unpack_from("<HH", b) == VERSION
    for at in range(min(256, len(data))):
        if data[at] == 0x78:
            try:
                out = inflate(data[at:])
            except ContainerError:
                continue
            if is_block(out):
                return out
    if is_block(data):
        return data
    raise ContainerError("no bytecode block")


def symbols(payload: bytes) -> list[tuple[int, str]]:
    """(character, class name) of a symbol tag; character 0 is the document."""
    if len(payload) < 2:
        return []
    out, at = [], 2
    for _ in range(struct.unpack_from("<H", payload)[0]):
        end = payload.find(b"\0", at + 2)
        if end < 0:
            break
        out.append((struct.unpack_from("<H", payload, at)[0], payload[at + 2 : end].decode("utf-8", "replace")))
        at = end + 1
    return out


def write_tag(tag: Tag) -> bytes:
    """Short header for short payloads, but never for bytecode."""
    n = len(tag.payload)
    if n < 0x3F and tag.kind not in (DO_ABC, DO_ABC2):
        return struct.pack("<H", tag.kind << 6 | n) + tag.payload
    return struct.pack("<HI", tag.kind << 6 | 0x3F, n) + tag.payload


def write_movie(header: bytes, tags: list[Tag], compress: bool = True) -> bytes:
    """A whole SWF with its length set anew."""
    body = header[8:] + b"".join(map(write_tag, tags))
    head = (b"CWS" if compress else b"FWS") + header[3:4] + struct.pack("<I", 8 + len(body))
    return head + (zlib.compress(body, 9) if compress else body)


def bytecode_tag(block: bytes, name: str = "", flags: int = 1) -> Tag:
    return Tag(DO_ABC2, struct.pack("<I", flags) + name.encode() + b"\0" + block, name)


def symbol_tag(pairs: list[tuple[int, str]]) -> Tag:
    return Tag(SYMBOLS, struct.pack("<H", len(pairs)) + b"".join(struct.pack("<H", c) + n.encode() + b"\0" for c, n in pairs))


def end_tag() -> Tag:
    return Tag(END, b"")


def plain_header(version: int = 40, width: int = 800, height: int = 600, rate: float = 24, frames: int = 1) -> bytes:
    """The header of a new movie; sizes in pixels."""
    sides = (0, width * 20, 0, height * 20)
    n = max(s.bit_length() for s in sides) + 1 if any(sides) else 0
    text = f"{n:05b}" + "".join(f"{s:0{n}b}" for s in sides if n)
    text += "0" * (-len(text) % 8)
    rect = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
    return b"FWS" + bytes([version]) + b"\0\0\0\0" + rect + struct.pack("<HH", round(rate * 256), frames)


class MovieBuilder:
    """A new movie, tag by tag."""

    def __init__(self, **header) -> None:
        self.header = plain_header(**header)
        self.tags: list[Tag] = []
        self.names: list[tuple[int, str]] = []

    def add_tag(self, tag: Tag) -> MovieBuilder:
        self.tags.append(tag)
        return self

    def add_block(self, block: bytes, name: str = "") -> MovieBuilder:
        return self.add_tag(bytecode_tag(block, name))

    def add_symbol(self, character: int, name: str) -> MovieBuilder:
        self.names.append((character, name))
        return self

    def set_document_class(self, name: str) -> MovieBuilder:
        return self.add_symbol(0, name)

    def build(self, compress: bool = False) -> bytes:
        tags = [*self.tags, *([symbol_tag(self.names)] if self.names else []), end_tag()]
        return write_movie(self.header, tags, compress)
