"""Numbers, blocks, code and containers: round trips and defined failures."""

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bytelens.codec import block as B
from bytelens.codec import code, container, numbers
from bytelens.codec.builder import BlockBuilder
from bytelens.codec.errors import BlockError, BytelensError, CodeError, ContainerError
from bytelens.functions.fixed import OPCODES

from .fixtures import game_block, test_class_block


@given(st.integers(0, (1 << 32) - 1))
def test_u30_round_trip(n):
    assert numbers.read_u30(numbers.write_u30(n), 0) == (n, len(numbers.write_u30(n)))


@given(st.integers(-(1 << 27), (1 << 27) - 1))
def test_s32_round_trip(n):
    assert numbers.read_s32(numbers.write_s32(n), 0)[0] == n


@given(st.integers(-(1 << 23), (1 << 23) - 1))
def test_s24_round_trip(n):
    assert numbers.read_s24(numbers.write_s24(n), 0) == (n, 3)


def test_numbers_cut_off():
    for read in (numbers.read_u30, numbers.read_s32, numbers.read_s24, numbers.read_d64):
        with pytest.raises(BlockError):
            read(b"", 0)
    assert numbers.read_u30(b"\xff\xff\xff\xff\xff\x01", 0) == ((1 << 35) - 1, 5)


def test_empty_block():
    data = bytes.fromhex("10002e00") + bytes(12)
    assert B.serialize(B.parse(data)) == data and len(B.to_rows(B.parse(data))) == 8


@pytest.mark.parametrize("data", [game_block(), test_class_block()])
def test_block_round_trip(data):
    assert B.serialize(B.parse(data)) == data
    rows = B.to_rows(B.parse(data))
    assert B.serialize(B.from_rows(rows[::-1])) == data


@pytest.mark.parametrize("n", range(4, len(game_block()), 23))
def test_cut_off_blocks_raise(n):
    with pytest.raises(BlockError):
        B.parse(game_block()[:n])


@given(st.binary(max_size=60))
def test_decode_covers_all_code(data):
    got = code.decode(data)
    assert sum(i.size for i in got) == len(data) and [i.offset for i in got] == [sum(x.size for x in got[:k]) for k in range(len(got))]


def test_decode_marks_what_it_does_not_know():
    got = code.decode(bytes([0xD0, 0xFE, 0x47]))
    assert [(i.mnemonic, i.after_unknown) for i in got] == [("getlocal_0", False), ("unknown_0xFE", True), ("returnvoid", True)]
    assert code.decode(b"\x2c")[0].truncated
    for bad in (b"\xfe", b"\x2c"):
        with pytest.raises(CodeError):
            code.decode(bad, strict=True)


def test_every_opcode_assembles():
    for op, (name, form) in OPCODES.items():
        args = [0, 0, 0] if name == "lookupswitch" else [1, 2, 3, 4] if form == "special" else [5] * len(form.split())
        raw = code.assemble((name, *args))
        (i,) = code.decode(raw, strict=True)
        assert i.opcode == op and i.size == len(raw)


def test_pools_are_interned():
    b = BlockBuilder()
    assert b.string("a") == b.string("a") == 1 and b.string("") == 0 and b.qname("x", "p") == b.qname("x", "p")
    assert b.ns_set([b.namespace("p")]) != b.ns_set([b.namespace("p")])


def movie(**options):
    return container.MovieBuilder(**options).add_block(game_block(), "main").add_symbol(3, "a.B").set_document_class("a.Main").build(True)


def test_movie_round_trip():
    data = movie(width=320, height=0)
    m = container.read_movie(data)
    assert [t.kind_name for t in m.tags] == ["DoABC2", "SymbolClass", "End"] and m.tags[0].name == "main"
    assert container.block_of(m.tags[0]) == game_block() and container.symbols(m.tags[1].payload) == [(3, "a.B"), (0, "a.Main")]
    assert container.write_movie(m.header, m.tags) == data
    plain = container.write_movie(m.header, m.tags, compress=False)
    assert plain[:3] == b"FWS" and struct.unpack_from("<I", plain, 4)[0] == len(plain)
    assert [t.payload for t in container.read_movie(plain).tags] == [t.payload for t in m.tags]


@pytest.mark.parametrize("data", [b"", b"FWS", b"ZWS\x0a" + bytes(20), b"CWS\x0a" + bytes(4) + b"no zlib", b"XYZ" + bytes(40)])
def test_bad_containers_raise(data):
    with pytest.raises(ContainerError):
        container.read_movie(data)


def test_bundles():
    import zlib

    for data in (game_block(), zlib.compress(game_block()), b"head" + zlib.compress(game_block())):
        assert container.read_bundle(data) == game_block()
    with pytest.raises(BytelensError):
        container.read_bundle(b"nothing")


def test_bombs_are_refused():
    import zlib

    with pytest.raises(ContainerError):
        container.inflate(zlib.compress(bytes(10_000)), most=100)
