"""Hashes of items and sets, and Hamming distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_bits(text: Column) -> Column:
    """The bits of up to 16 hex digits, as a signed integer."""
    return F.conv(text, 16, -10).cast("bigint")


def hamming_bits(a: Column, b: Column) -> Column:
    """Different bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def _valid_hex(x: Column) -> Column:
    return x.rlike("^([0-9a-fA-F]{2})*$")


def hamming_bytes(a: Column, b: Column) -> Column:
    """Different bits of two hex strings of up to eight bytes; each byte that one lacks counts 8, and strings that aren't hex count 64."""
    n = F.least(F.length(a), F.length(b))
    same = F.when(n == 0, F.lit(0)).otherwise(hamming_bits(hex_bits(F.substring(a, F.lit(1), n)), hex_bits(F.substring(b, F.lit(1), n))))
    return F.when(_valid_hex(a) & _valid_hex(b), same + 4 * F.abs(F.length(a) - F.length(b))).otherwise(64)


def hamming_nibbles(a: Column, b: Column) -> Column:
    """Different bits of two strings of hex digits; each digit that one lacks counts 4."""
    n = F.least(F.length(a), F.length(b))
    same = F.when(n == 0, F.lit(0)).otherwise(hamming_bits(hex_bits(F.substring(a, F.lit(1), n)), hex_bits(F.substring(b, F.lit(1), n))))
    return same + 4 * F.abs(F.length(a) - F.length(b))


def id_bits(key: Column) -> Column:
    """60 bits of a key's MD5, to be combined over a set in any order."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def member_digest(key: Column) -> Column:
    """An aggregate over a set's rows that tells sets apart, needs no list of the members and combines in the map tasks."""
    return F.bit_xor(id_bits(key))


def fingerprint(members: Column) -> Column:
    """SHA-1 of the sorted distinct members, joined by commas."""
    return F.sha1(F.array_join(F.transform(F.array_sort(F.array_distinct(members)), lambda x: x.cast("string")), ","))


def person_id(name: Column) -> Column:
    """A stable number for a name: 15 hex digits of the SHA-256 of the trimmed lower-case name."""
    return F.conv(F.substring(F.sha2(F.lower(F.trim(name)), 256), 1, 15), 16, 10).cast("bigint")


def config_hash(*parts: Column) -> Column:
    """SHA-1 of the parts as JSON, in the order given."""
    return F.sha1(F.to_json(F.struct(*parts)))


def array_jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def interval_iou(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared over all time of two closed intervals; two equal points share all."""
    shared = F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))
    whole = F.greatest(a2, b2) - F.least(a1, b1)
    return F.when(whole > 0, shared / whole).otherwise(F.when((a1 == b1) & (a2 == b2), 1.0).otherwise(0.0))
