"""Digests, fixed-point and bit functions."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_id(*parts: Column, bits: int = 60) -> Column:
    """A non-negative BIGINT from the SHA-256 of the parts, each length-prefixed so that no two lists of parts run together."""
    text = F.concat(*[F.concat(F.length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit("\x00"))) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, bits // 4), 16, 10).cast("long")


def state_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n_rows, digest): a digest of a set of rows that depends on neither order nor partitioning.

    Row digests are added up as four 60-bit numbers with map-side combine; nothing is collected in order.
    """
    text = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    hexed = [F.lpad(F.coalesce((w % F.lit(2**60)).cast("long"), F.lit(0)).cast("string"), 19, "0") for w in words]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat(*hexed), 256).alias("digest"))


@F.pandas_udf(T.BinaryType())
def blake2b_8(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=8).digest())


def hmac_sha256(secret: bytes):
    """A function of a binary column: its HMAC-SHA256 in hex."""

    @F.pandas_udf(T.StringType())
    def sign(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else hmac.new(secret, bytes(b), hashlib.sha256).hexdigest())

    return sign


# Constants of the 64-bit mixer and of the two bit rules.
MIX_1, MIX_2, MIX_KEY = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA7C15EED1234ABCD
RULE_ROW, RULE_COL = 1315423911, 2654435761


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit mixer on unsigned words, which SQL integers can't hold without overflow."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(T.IntegerType())
def mixed_bit(row: pd.Series, col: pd.Series) -> pd.Series:
    """The mixed rule's bit of a matrix cell."""
    x = (row.to_numpy(np.uint64) << np.uint64(32)) ^ col.to_numpy(np.uint64) ^ np.uint64(MIX_KEY)
    return pd.Series((mix64(x) & np.uint64(1)).astype(np.int32))


def plain_bit(row: Column, col: Column) -> Column:
    """The plain rule's bit of a matrix cell: whether the low three bits of the mixture are 0 or 3."""
    low = (row * RULE_ROW).bitwiseXOR(col * RULE_COL).bitwiseXOR(row + col).bitwiseAND(F.lit(7).cast("long"))
    return F.when(low.isin(0, 3), 1).otherwise(0)


def quantized(attenuation: Column) -> Column:
    """0..1 as 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(attenuation * 255.0).cast("int")))


def scaled(energy: Column, attenuation: Column) -> Column:
    """Fixed-point product of an energy and an attenuation 0..255."""
    return F.shiftright(energy * attenuation, 8)


def bit_of(bits: Column, index: Column) -> Column:
    """Bit ``index`` (least significant first in each byte) of a binary column."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(index / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (index % 8).cast("int")).bitwiseAND(F.lit(1))
