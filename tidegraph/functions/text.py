"""Names, masks and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegraph.config import EDGE_TYPES

# Maturities in order, and roles by bit.
MATURITY = ["RAW", "HYPOTHESIS", "CANDIDATE", "VERIFIED"]
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:\-]{0,127}$"


def edge_type_name(edge_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, n in EDGE_TYPES.items() for x in (i, n)])[edge_type]


def maturity_rank(maturity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MATURITY]), maturity).cast("int") - 1


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def lines_of(text: Column) -> Column:
    """Lines with their ends kept, so that joining them gives the text back; no line for an empty text."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s+"), F.lit(0))


def prefix_record(index: Column) -> Column:
    """The record of a numbered family (a format other tools rely on)."""
    # Fixed value: the family's format.
    return F.format_string("9606.ENSP%011d|STATUS=OK|SOURCE=G1|VALUE=%02d\n", index, index % 97)


def pack_record(prefix: str, file: Column, record: Column) -> Column:
    """The record of a family of files (a format other tools rely on)."""
    # Fixed value: the family's format and moduli.
    value, group = (record * 17 + file * 31) % 1000, F.floor(record / 128) % 64
    return F.format_string(prefix + "|F=%03d|R=%08d|TYPE=A|STATUS=OK|GROUP=%02d|VALUE=%03d\n", file, record, group, value)
