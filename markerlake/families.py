"""Marker families as dimension tables: families, their bit layout, and their codes.

Small families are stated here. Codes of larger ones are a parameter: `with_codes` takes the layout of a known
family and a list of codes, and `read_codes` reads such a list from text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Family:
    name: str
    nbits: int
    h: int
    width_at_border: int
    total_width: int
    reversed_border: bool
    codes: tuple[int, ...]
    bits: tuple[tuple[int, int], ...]  # (x, y) of each bit, the highest first


def _turned(quarter: list[tuple[int, int]], width: int, centre: bool) -> tuple[tuple[int, int], ...]:
    """A layout whose quarters are the first one turned by 90 degrees each; an odd last bit is the centre."""
    found = part = list(quarter)
    for _ in range(3):
        part = [(width - 1 - y, x) for x, y in part]
        found = found + part
    return tuple(found + [(width // 2, width // 2)] * centre)


def _square(width: int) -> tuple[tuple[int, int], ...]:
    """All cells within a border of width one, ring by ring."""
    quarter = [(x, y) for y in range(1, width // 2) for x in range(y, width - 1 - y)]
    return _turned(quarter, width, width % 2 == 1)


# The codes of the small families, and the first quarter of the layouts that are no full squares.
TAG16H5 = (
    0x27C8, 0x31B6, 0x3859, 0x569C, 0x6C76, 0x7DDB, 0xAF09, 0xF5A1, 0xFB8B, 0x1CB9, 0x28CA, 0xE8DC, 0x1426, 0x5770, 0x9253,
    0xB702, 0x63A, 0x8F34, 0xB4C0, 0x51EC, 0xE6F0, 0x5FA4, 0xDD43, 0x1AAA, 0xE62F, 0x6DBC, 0xB6EB, 0xDE10, 0x154D, 0xB57A,
)
TAG25H9 = (
    0x156F1F4, 0x1F28CD5, 0x16CE32C, 0x1EA379C, 0x1390F89, 0x34FAD0, 0x7DCDB5, 0x119BA95, 0x1AE9DAA, 0xDF02AA, 0x82FC15, 0x465123,
    0xCEEE98, 0x1F17260, 0x14429CD, 0x17248A8, 0x16AD452, 0x9670AD, 0x16F65B2, 0xB8322B, 0x5D715B, 0x1A1C7E7, 0xD7890D, 0x1813522,
    0x1C9C611, 0x99E4A4, 0x855234, 0x17B81C0, 0xC294BB, 0x89FAE3, 0x44DF5F, 0x1360159, 0xEC31E8, 0x1BCC0F6, 0xA64F8D,
)
CIRCLE21H7 = (
    0x157863, 0x47E28, 0x1383ED, 0x953C, 0xDA68B, 0x1CAC50, 0xBB215, 0x16CEEE, 0x5D4B3, 0x1FF751, 0xEFD16, 0x72B3E, 0x163103,
    0x106E56, 0x1996B9, 0xC0234, 0x624D2, 0x1FA985, 0x344A5, 0x762FB, 0x19E92B, 0x43755, 0x1A4F4, 0x10FAD8, 0x1B52, 0x17E59F,
    0xE6F70, 0xED47A, 0xC9931, 0x14DF2, 0xA06F1, 0xE5041, 0x12EC03, 0x16724E, 0xAF1A5, 0x8A8AC, 0x15B39, 0x1EC1E3,
)
CIRCLE21_QUARTER = [(1, -2), (2, -2), (3, -2), (1, 1), (2, 1)]
STANDARD41_QUARTER = [(-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (3, -2), (4, -2), (5, -2), (1, 1), (2, 1)]

FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("tag16h5", 16, 5, 6, 8, False, TAG16H5, _square(6)),
        Family("tag25h9", 25, 9, 7, 9, False, TAG25H9, _square(7)),
        Family("tag36h10", 36, 10, 8, 10, False, (), _square(8)),
        Family("tag36h11", 36, 11, 8, 10, False, (), _square(8)),
        Family("tagCircle21h7", 21, 7, 5, 9, True, CIRCLE21H7, _turned(CIRCLE21_QUARTER, 5, True)),
        Family("tagStandard41h12", 41, 12, 5, 9, True, (), _turned(STANDARD41_QUARTER, 5, True)),
    )
}


def with_codes(name: str, codes: list[int]) -> Family:
    """A family of known layout with the given codes."""
    if len(codes) >= 65_536 or len(set(codes)) != len(codes):
        raise ValueError("a family has fewer than 65,536 codes, all distinct")
    return replace(FAMILIES[name], codes=tuple(codes))


def read_codes(path: str) -> list[int]:
    """The hexadecimal numbers of a text file, in order."""
    with open(path, encoding="utf-8") as f:
        return [int(x, 16) for x in re.findall(r"\b0x([0-9a-fA-F]{2,16})", f.read())]


def family(name: str) -> Family:
    try:
        return FAMILIES[name]
    except KeyError:
        raise RuntimeError(f"unknown family {name!r}; known: {', '.join(FAMILIES)}") from None


def family_tables(spark: SparkSession, families: list[Family]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(families, family_codes, family_bits); each is bounded by the formats, 65,535 codes a family."""
    f = spark.createDataFrame([(x.name, x.nbits, x.h, x.width_at_border, x.total_width, x.reversed_border) for x in families], "family string, nbits int, h int, width_at_border int, total_width int, reversed_border boolean")
    codes = spark.createDataFrame([(x.name, i, c) for x in families for i, c in enumerate(x.codes)], "family string, id int, code long")
    bits = spark.createDataFrame([(x.name, i, bx, by) for x in families for i, (bx, by) in enumerate(x.bits)], "family string, i int, x int, y int")
    return f, codes, bits
