"""Listings: instructions with their operands as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..codec.block import Block
from ..codec.classes import owners
from ..codec.code import decode, resolved
from ..sources.files import rows_of

LISTING = "resource_id long, abc_id int, body_index long, method_index long, class_name string, member_name string, seq long, offset long, mnemonic string, text string"


def lines(b: Block, _: int) -> Iterator[dict]:
    who = owners(b)
    for k, body in enumerate(b.bodies):
        owner, member, *_ = who.get(body.method, ("", f"method_{body.method}"))
        for seq, i in enumerate(decode(body.code)):
            yield {
                "body_index": k, "method_index": body.method, "class_name": owner, "member_name": member, "seq": seq, "offset": i.offset, "mnemonic": i.mnemonic,
                "text": " ".join([i.mnemonic, ", ".join(resolved(b, i))]).strip(),
            }


def listing(blocks: DataFrame) -> DataFrame:
    return blocks.mapInArrow(rows_of(lines, LISTING), LISTING)
