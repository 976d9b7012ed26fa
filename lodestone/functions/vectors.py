"""Vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 4294967295


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; 0 for different lengths, empty vectors and zero vectors."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as struct<hi, lo> of two unsigned 32-bit halves.

    Each half is multiplied on its own, so nothing overflows a signed 64-bit number.
    """
    data = F.encode(text, "utf-8")
    positions = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(positions, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))

    def step(s, octet):
        x = s["lo"].bitwiseXOR(octet)
        return F.struct(
            (s["hi"] * 435 + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8) + F.shiftrightunsigned(x * 435, 32)).bitwiseAND(F.lit(_M)).alias("hi"),
            (x * 435).bitwiseAND(F.lit(_M)).alias("lo"),
        )

    start = F.struct(F.lit(3421674724).cast("bigint").alias("hi"), F.lit(2216829733).cast("bigint").alias("lo"))
    return F.aggregate(octets, start, step)


def bucket(h: Column, dimension: int) -> Column:
    """The unsigned hash modulo dimension."""
    return F.pmod(F.pmod(h["hi"], F.lit(dimension)) * (4294967296 % dimension) + F.pmod(h["lo"], F.lit(dimension)), F.lit(dimension)).cast("int")


def sign(h: Column) -> Column:
    """+1 for an even hash, -1 for an odd one."""
    return F.when(h["lo"].bitwiseAND(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(-1))
