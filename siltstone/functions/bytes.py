"""Helpers on binary keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def successor(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with a prefix; None where there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def starts_with(key: Column, prefix: bytes) -> Column:
    """Key range of a prefix, in a form that Parquet statistics can prune by."""
    above = successor(prefix)
    low = key >= F.lit(prefix)
    return low if above is None else low & (key < F.lit(above))


#: Bytes of a change in the log beside its key and value.
FRAME = 62


def frame_bytes(key: Column, value: Column) -> Column:
    """Size of one change in the log: its payload and frame."""
    return F.lit(FRAME) + F.length(key) + F.coalesce(F.length(value), F.lit(0))


def _low_half(hexed: Column, start: int) -> Column:
    """8 hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(hexed, start, 8), 16, 10).cast("long")


def bloom_contains(key: Column, bits: Column, hashes: Column, bloom: Column) -> Column:
    """Whether a Bloom filter may hold a key; null where key or filter is null.

    With a and b the first and last 8 bytes of md5(key) as unsigned numbers, bits
    ((a + i b) mod 2^64) mod ``bits`` for i = 0 .. hashes-1 must be set, bit j being
    bit j mod 8, lowest first, of byte j div 8. 64-bit arithmetic is done on 32-bit
    halves, as longs are signed.
    """
    digest = F.md5(key)
    a1, a0 = _low_half(digest, 1), _low_half(digest, 9)
    b1, b0 = _low_half(digest, 17), _low_half(digest, 25)
    two32 = F.lit(1 << 32)

    def is_set(i: Column) -> Column:
        low = a0 + i * b0
        high = F.pmod(a1 + i * b1 + F.floor(low / two32).cast("long"), two32)
        low = F.pmod(low, two32)
        # (high 2^32 + low) mod bits without leaving 63 bits, for filters below 2^31 bits
        bit = F.pmod(F.pmod(F.pmod(high, bits) * F.pmod(two32, bits), bits) + low, bits)
        byte = F.conv(F.hex(F.substring(bloom, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        return F.pmod(F.shiftright(byte.cast("int"), 0) / F.pow(F.lit(2), bit % 8), F.lit(2)) >= 1

    every = F.forall(F.sequence(F.lit(0), hashes - 1), lambda i: is_set(i.cast("long")))
    return F.when(key.isNotNull() & bloom.isNotNull() & (bits > 0) & (hashes > 0), every)
