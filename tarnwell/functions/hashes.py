"""Perceptual and content hashes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed_hex(text: Column | str) -> Column:
    """1 to 16 hexadecimal digits as the 64-bit integer with these bits; anything else is null."""
    c = _col(text)
    return F.when(c.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(c, 16, -10).cast("bigint"))


def perceptual_bits(text: Column | str) -> Column:
    """The 64 bits of a perceptual hash in any notation, or null if it can't be read.

    Letter case, white space, separators, missing leading zeros and a prefix (``0x``, ``x``, ``#`` or a name with
    ``:`` or ``=``) are set aside. More than 16 digits, other characters or no digits at all are unreadable.
    """
    c = F.lower(_col(text))
    c = F.regexp_replace(c, r"[\s\u00a0\u200b\ufeff\x00]+", "")
    c = F.regexp_replace(c, r"^(?:[a-z][a-z0-9_-]*[:=])?(?:0x|x|#)?", "")
    named = _col(text).rlike(r"(?i)^\s*[0-9a-f]{2}:")
    pairs = F.lower(F.regexp_replace(_col(text), r"[\s:_.-]+", ""))
    return signed_hex(F.when(named, pairs).otherwise(F.regexp_replace(c, "[:_.-]+", "")))


def content_digest(text: Column | str) -> Column:
    """A SHA-256 as 64 lower-case hex digits; letter case, white space and prefix set aside, null if it is none."""
    c = F.regexp_replace(F.lower(_col(text)), r"[\s\u00a0\u200b\ufeff\x00]+", "")
    c = F.regexp_replace(c, r"^(?:sha-?_?256[:=-]?|0x)", "")
    return F.when(c.rlike("^[0-9a-f]{64}$"), c)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two 64-bit hashes differ."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Percentage of equal bits, rounded half to even at one digit."""
    return F.bround((F.lit(64) - hamming(a, b)) * F.lit(100.0) / F.lit(64.0), 1)


def difference_hash(pixels: Column | str) -> Column:
    """64-bit difference hash of a 9 x 8 gray thumbnail, given row by row as an array of 72 numbers.

    A bit is set where the left pixel is brighter than its right neighbour; the first bit is the top one. Arrays of
    another length, and null, give null.
    """
    p = _col(pixels)

    def bit(acc: Column, i: Column) -> Column:
        at = (F.floor(i / 8) * 9 + i % 8).cast("int")
        brighter = F.element_at(p, at + 1) > F.element_at(p, at + 2)
        return F.shiftleft(acc, 1).bitwiseOR(F.when(brighter, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)
    return F.when(F.size(p) == 72, bits)


def hex16(bits: Column | str) -> Column:
    """The 16 hexadecimal digits of a 64-bit hash."""
    return F.lower(F.lpad(F.hex(_col(bits)), 16, "0"))
