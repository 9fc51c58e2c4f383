"""Version chains of keys and pinned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import small


def version_chain(deltas: DataFrame) -> DataFrame:
    """(key, seq, at_ms, version, deleted, current): ordinals in the chain, the latest is current.

    A deletion of a key that has no version yet is ignored.
    """
    chain = Window.partitionBy("key").orderBy("seq")
    seen = F.max(F.col("op") != "Delete").over(chain.rowsBetween(Window.unboundedPreceding, 0))
    known = deltas.withColumn("_known", seen).filter("_known")
    return known.select("key", "seq", "at_ms", F.row_number().over(chain).cast("long").alias("version"), F.col("tombstone").alias("deleted"), F.lead("seq").over(chain).isNull().alias("current"))


def current_version(chain: DataFrame) -> DataFrame:
    return chain.filter("current and not deleted")


def get_version(chain: DataFrame, version: int) -> DataFrame:
    return chain.filter((F.col("version") == version) & ~F.col("deleted"))


def pinned_read(deltas: DataFrame, pins: DataFrame) -> DataFrame:
    """The newest delta of each key at or before each pin (pin, position)."""
    open_ = small.constants(pins, "pin", "position")
    # One pass over the log: every key keeps a maximum per open snapshot.
    n = len(pins.select("pin").limit(small.MOST).collect())
    tops = deltas.groupBy("key").agg(*(F.max(F.when(F.col("seq") <= open_[i]["position"], F.col("seq"))).alias(f"_{i}") for i in range(n)))
    seen = tops.select("key", F.explode(F.array(*(F.struct(open_[i]["pin"].alias("pin"), F.col(f"_{i}").alias("seq")) for i in range(n)))).alias("s")) if n else tops.select("key", F.explode(F.array().cast("array<struct<pin:bigint,seq:bigint>>")).alias("s"))
    return seen.select("s.pin", "key", "s.seq").filter("seq IS NOT NULL")


def live_pins(pins: DataFrame, now_ms: int) -> DataFrame:
    """Pins (pin, position, acquired_ms, ttl_ms) that still hold their snapshot; at the end of its time a pin still counts."""
    return pins.filter(F.lit(now_ms) - F.col("acquired_ms") <= F.col("ttl_ms"))
