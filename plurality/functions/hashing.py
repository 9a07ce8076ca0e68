"""Keyed deterministic hashing with built-in expressions only.

The 64-bit value is the lower half of the MD5 digest (bytes 8..15) read as an
unsigned little-endian integer. Spark has no unsigned long, so the value is
carried as its 16-digit big-endian hex string and converted with ``conv``
(unsigned) to a decimal(20,0) or a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT64_RANGE = 18446744073709551616.0  # 2**64


def lo64_hex(digest: Column) -> Column:
    """Big-endian hex of bytes 8..15 (read little-endian) of an MD5 hex digest.

    Byte 15 is the most significant, so the byte pairs of the second half of
    the digest are emitted in reverse order. Pass a digest column that was
    computed in an earlier projection, so the hash runs once per row."""
    return F.concat(*[F.substring(digest, start, 2) for start in range(31, 15, -2)])


def md5_lo64_hex(text: Column) -> Column:
    return lo64_hex(F.md5(text))


def md5_lo64_decimal(text: Column) -> Column:
    return F.conv(md5_lo64_hex(text), 16, 10).cast("decimal(20,0)")


def keyed_text(seed: str, key: Column, suffix: str) -> Column:
    return F.concat(F.lit(seed + ":"), key.cast("string"), F.lit(":" + suffix))


def _byte_swap32(word: Column) -> Column:
    """Reverses the four bytes of a 32-bit value held in a long."""
    m = F.lit(255)
    return (
        F.shiftleft(word.bitwiseAND(m), 24)
        + F.shiftleft(F.shiftright(word, 8).bitwiseAND(m), 16)
        + F.shiftleft(F.shiftright(word, 16).bitwiseAND(m), 8)
        + F.shiftright(word, 24).bitwiseAND(m)
    )


def lo64_words(digest: Column) -> tuple[Column, Column]:
    """(high, low) 32-bit words of the little-endian value of digest bytes
    8..15: bytes 15..12 form the high word, 11..8 the low word. Two short
    ``conv`` calls plus long arithmetic (cheaper than reversing the hex
    string and converting 16 digits)."""
    first = F.conv(F.substring(digest, 17, 8), 16, 10).cast("long")   # bytes 8..11, big-endian
    second = F.conv(F.substring(digest, 25, 8), 16, 10).cast("long")  # bytes 12..15
    return _byte_swap32(second), _byte_swap32(first)


def uniform_of_digest(digest: Column) -> Column:
    """u in [0, 1) from an MD5 hex digest column: lo64 / 2**64, with the
    unsigned value rounded once to double (hi * 2**32 is exact)."""
    hi, lo = lo64_words(digest)
    return (hi.cast("double") * F.lit(4294967296.0) + lo.cast("double")) / F.lit(UINT64_RANGE)


def bucket_of_digest(digest: Column, k: int) -> Column:
    """0-based bucket lo64 mod k, exact: (hi mod k) * (2**32 mod k) + lo mod k."""
    hi, lo = lo64_words(digest)
    kk = F.lit(k).cast("long")
    return (((hi % kk) * F.lit((1 << 32) % k).cast("long") + lo % kk) % kk).cast("int")


def unit_uniform(seed: str, key: Column, suffix: str) -> Column:
    """u in [0, 1): md5_lo64(seed ':' key ':' suffix) / 2**64; NULL key -> NULL.
    Single-expression form; operators stage the digest instead."""
    return uniform_of_digest(F.md5(keyed_text(seed, key, suffix)))


def bucket_index(key: Column, suffix: str, k: int) -> Column:
    """0-based bucket md5_lo64(key ':' suffix) mod k (single-expression form)."""
    return bucket_of_digest(F.md5(F.concat(key.cast("string"), F.lit(":" + suffix))), k)
