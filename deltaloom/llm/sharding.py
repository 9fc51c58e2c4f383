"""Sharding: a reproducible shuffle whose shard and slot can be computed.

Every row gets a global row number (its rank by document id).  A keyed Feistel
network over the smallest power of two that holds all row numbers, with cycle
walking back into range, permutes those numbers.  Position ``p`` lies in shard
``p mod n_shards`` at slot ``p div n_shards``: shard sizes differ by one row at
most, slots have no gap, and :func:`locate` / :func:`row_at` compute the place
of a row, and the row of a place, from ``(row number, rows, seed)`` alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

ROUNDS = 8
_M32 = 0xFFFFFFFF
_INDEX_BITS = 33  # of monotonically_increasing_id


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:4], "big") for i in range(ROUNDS)]


def _mix(v: np.ndarray, key: int) -> np.ndarray:
    """Round function on halves of up to 32 bits; every product stays below 2**63."""
    v = (v + key) & _M32
    for _ in range(2):
        v = ((v ^ (v >> 16)) * 0x45D9F3B) & _M32
    return v ^ (v >> 16)


def _halves(n: int) -> tuple[int, int]:
    bits = max(1, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: np.ndarray, n: int, keys: list[int], inverse: bool) -> np.ndarray:
    left_bits, right_bits = _halves(n)
    left, right = x >> right_bits, x & ((1 << right_bits) - 1)
    for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        if i % 2 == 0:
            left = left ^ (_mix(right, keys[i]) & ((1 << left_bits) - 1))
        else:
            right = right ^ (_mix(left, keys[i]) & ((1 << right_bits) - 1))
    return (left << right_bits) | right


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of ``0..n-1`` (or its inverse) at each of ``x``."""
    keys = round_keys(seed)
    out = _network(np.asarray(x, dtype=np.int64), n, keys, inverse)
    while (outside := out >= n).any():
        out[outside] = _network(out[outside], n, keys, inverse)
    return out


def locate(row: int, n: int, n_shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int) -> int:
    """The row number that lies at a place."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, inverse=True)[0])


def number_rows(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """Adds ``row_no``: 0, 1, ... in the order of ``order`` (nulls first), and the row count.

    A range sort of the given narrow columns; only one count per sorted
    partition goes to the driver.  Rows that are equal in all of ``order`` are
    told apart by the partition of the scan, so that a key that repeats
    without end is still cut into ranges no larger than a scan partition.
    """
    keyed = scratch.write(df.withColumn("_part", F.spark_partition_id()), "keys")
    by = [*order, "_part"]
    ranked = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_part")
    ranked = scratch.write(ranked.withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    scratch.drop("keys")
    part = F.shiftrightunsigned("_mid", _INDEX_BITS)
    counts = sorted((r["part"], r["n"]) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    # One row per partition of the sort, whatever the data.
    offsets = df.sparkSession.createDataFrame(starts, "_k long, _start long")
    numbered = ranked.join(F.broadcast(offsets), part == F.col("_k"))
    row_no = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return numbered.withColumn("row_no", row_no).drop("_k", "_start", "_mid"), total


def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 20240501, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows of ``docs`` into ``n_shards`` shards, counts at most one apart.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, law (``rows``), shard,
    slot, grown_shard (null: this law has none), row_no.  A null text counts
    as empty (size 1, crc 0); null ids come first; rows that agree in id, size
    and crc take neighbouring row numbers in any order; an empty table gives
    an empty result; other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(id_col), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    numbered, n = number_rows(narrow, [id_col, "size", "text_crc32"], Scratch(docs.sparkSession, "sharding"))

    @F.pandas_udf(T.LongType())
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = numbered.withColumn("_p", place("row_no"))
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.expr(f"_p div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
