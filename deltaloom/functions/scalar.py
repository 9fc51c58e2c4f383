"""Scalar functions: content ids, buckets, identifiers, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def hmac_sha256(key: bytes, message: Column) -> Column:
    """RFC 2104 with a key known to the driver; all in built-in functions."""
    if not key:
        raise ValueError("a key is required")
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def log2_bucket(value: Column) -> Column:
    """Zero for zero, else the bit length."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value))).cast("long")


def size_bucket(n: Column) -> Column:
    """The first of 128, 256, 512, 1024 that 64 + 8 n fits, else 1024."""
    size = 64 + 8 * n
    return F.when(size <= 128, 128).when(size <= 256, 256).when(size <= 512, 512).otherwise(1024)


def retry_bucket(raw: Column) -> Column:
    return F.when(raw <= 50, 50).when(raw <= 100, 100).when(raw <= 250, 250).otherwise(500)


def uuid5(namespace_hex: Column, name: Column) -> Column:
    """Name-based identifier, version 5, from a namespace of 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(namespace_hex), name.cast("binary")))
    variant = F.substring(F.lit("89ab" * 4), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def durability_defaults(nodes: Column) -> dict[str, Column]:
    """Copies, least acknowledgements and strategy for a cluster size."""
    return {
        "copies": F.when(nodes <= 1, 1).when(nodes == 2, 2).when(nodes <= 5, 3).otherwise(6),
        "min_acks": F.when(nodes <= 1, 1).when(nodes == 2, 2).when(nodes <= 5, 2).otherwise(4),
        "strategy": F.when(nodes <= 5, "replication").otherwise("ec-4-2"),
    }


def version_check(reader: Column, record: Column) -> Column:
    return F.when(reader == record, "equal").when(reader > record, "reader_newer").otherwise("reader_older")


def usage_ratio(used: Column, capacity: Column) -> Column:
    return F.when(capacity == 0, F.lit(0.0)).otherwise(used / capacity)


def inline_flag(chunks: Column, size: Column, limit: int = 4096) -> Column:
    return (chunks == 0) & (size > 0) & (size <= limit)


def inline_key(key_hex: Column, seq: Column) -> Column:
    """A key of 32 bytes (in hex) whose last eight are mixed with the sequence's, least byte first; its own inverse."""
    little = F.concat(*(F.substring(F.lpad(F.lower(F.hex(seq)), 16, "0"), 15 - 2 * i, 2) for i in range(8)))
    word = lambda text: F.conv(text, 16, -10).cast("long")
    mixed = F.lpad(F.lower(F.hex(word(F.substring(key_hex, 49, 16)).bitwiseXOR(word(little)))), 16, "0")
    return F.concat(F.substring(key_hex, 1, 48), mixed)
