"""The ordered change log: scans, appends, compaction, garbage collection, gaps.

A delta is (seq, shard, key, op, tombstone, at_ms, payload_size).  Windows are
partitioned by key or shard; a shard is bounded by its split ceiling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER_BYTES = 128


def log_range_scan(deltas: DataFrame, shard: int, first: int, last: int) -> DataFrame:
    """Deltas of a shard with first <= seq <= last, in order."""
    if first > last:
        raise ValueError(f"empty range: {first} > {last}")
    return deltas.filter((F.col("shard") == shard) & F.col("seq").between(first, last)).orderBy("seq")


def log_append(log: DataFrame, arriving: DataFrame, shards: DataFrame) -> DataFrame:
    """New sequence numbers tip + 1, ... in order of arrival (``arrival``) per shard.

    ``shards`` has (shard, state, range_start, range_end).  A write is rejected
    where the shard does not take writes or the key lies outside its range.
    """
    tips = log.groupBy("shard").agg(F.max("seq").alias("tip"))
    known = arriving.join(F.broadcast(shards), "shard").join(F.broadcast(tips), "shard", "left")
    refused = F.when(F.col("state").isin("Maintenance", "Retiring", "Election", "QuorumLost"), F.col("state")).when(
        (F.col("key") < F.col("range_start")) | (F.col("key") >= F.col("range_end")), F.lit("OutOfRange")
    )
    judged = known.withColumn("refused", refused)
    order = Window.partitionBy("shard", F.col("refused").isNull()).orderBy("arrival")
    number = F.when(F.col("refused").isNull(), F.coalesce("tip", F.lit(0)) + F.row_number().over(order))
    return judged.withColumn("new_seq", number).withColumn("tombstone", F.col("op") == "Delete").select("shard", "arrival", "key", "op", "tombstone", "refused", "new_seq")


def gc_boundary(consumers: DataFrame) -> DataFrame:
    """The position that every consumer has passed; null without consumers."""
    return consumers.agg(F.min("position").alias("boundary"))


def stalled_consumers(consumers: DataFrame, threshold: int) -> DataFrame:
    """Consumers further behind the front than ``threshold``."""
    front = consumers.agg(F.max("position").alias("front"))
    lag = F.col("front") - F.col("position")
    return consumers.crossJoin(F.broadcast(front)).select("consumer", "position", lag.alias("lag")).filter(F.col("lag") > threshold)


def consumer_advance(cursors: DataFrame, moves: DataFrame, buffered: int | None = None) -> DataFrame:
    """Cursors after moves (consumer, position): forward only; the sentinel ``buffered`` is refused."""
    if buffered is not None:
        moves = moves.filter(F.col("position") != buffered)
    return cursors.unionByName(moves).groupBy("consumer").agg(F.max("position").alias("position"))


def compact_latest(deltas: DataFrame, boundary: DataFrame) -> DataFrame:
    """The newest delta of each key; a tombstone goes once every consumer has passed it."""
    newest = Window.partitionBy("key").orderBy(F.desc("seq"))
    latest = deltas.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    edge = boundary.select(F.coalesce("boundary", F.lit(0)).alias("_edge"))  # one row
    return latest.crossJoin(F.broadcast(edge)).filter(~(F.col("tombstone") & (F.col("seq") < F.col("_edge")))).drop("_edge").orderBy("seq")


def compact_versions(deltas: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` (at least one) deltas of each key, never a deletion."""
    newest = Window.partitionBy("key").orderBy(F.desc("seq"))
    return deltas.withColumn("_n", F.row_number().over(newest)).filter((F.col("_n") <= max(keep, 1)) & (F.col("op") != "Delete")).drop("_n")


def truncate_log(deltas: DataFrame, boundary: DataFrame) -> DataFrame:
    edge = boundary.select(F.coalesce("boundary", F.lit(0)).alias("_edge"))
    return deltas.crossJoin(F.broadcast(edge)).filter(F.col("seq") >= F.col("_edge")).drop("_edge")


def needs_compaction(deltas: DataFrame, per_mille: int = 300) -> DataFrame:
    """Per shard whether deletions make up the share; an empty shard does not appear."""
    deletes, total = F.count_if(F.col("op") == "Delete"), F.count("*")
    return deltas.groupBy("shard").agg(deletes.alias("deletes"), total.alias("total")).withColumn("needed", F.col("deletes") * 1000 >= F.col("total") * per_mille)


def shard_sizes(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("shard").agg(F.count("*").alias("delta_count"), F.sum(F.col("payload_size") + HEADER_BYTES).alias("byte_size"))


def seq_gap(deltas: DataFrame, step: int = 1) -> DataFrame:
    """Places where a shard's numbers jump: the number expected and the one found."""
    before = F.lag("seq").over(Window.partitionBy("shard").orderBy("seq"))
    return deltas.select("shard", "seq", (before + step).alias("expected")).filter("expected <> seq")


def first_gap(deltas: DataFrame, step: int = 1) -> DataFrame:
    """Where a reader of each shard must halt."""
    return seq_gap(deltas, step).groupBy("shard").agg(F.min_by("expected", "seq").alias("expected"), F.min("seq").alias("found"))


def cdc_gap_check(states: DataFrame) -> DataFrame:
    """Replication gap of (peer, last_seq, expected): without a state, any expected number over zero is one."""
    gap = F.when(F.col("last_seq").isNull(), F.col("expected") > 0).otherwise(F.col("last_seq") + 1 != F.col("expected"))
    return states.withColumn("gap", gap)


def merge_order() -> list[Column]:
    """Order in which two shards' deltas interleave: key, clock, shard."""
    return [F.col("key"), F.col("at_ms"), F.col("seq"), F.col("shard")]
