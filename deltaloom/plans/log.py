"""Queries over the change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import log
from deltaloom.sources import model

from .registry import query


@query("SELECT seq, shard, key, op, payload_size FROM deltas WHERE shard = 1 AND seq BETWEEN 100 AND 5000")
def log_range_scan(spark, d):
    return log.log_range_scan(model.deltas(spark, d), 1, 100, 5000).select("seq", "shard", "key", "op", "payload_size")


@query("""
, s(shard, state, lo, hi) AS (VALUES (0, 'Active', 0, 80), (1, 'Active', 0, 1000000), (2, 'Maintenance', 0, 1000000), (3, 'Active', 0, 1000000)),
tips AS (SELECT shard, max(seq) AS tip FROM deltas WHERE seq < 500 GROUP BY 1),
j AS (SELECT d.shard, d.seq AS arrival, d.key, d.op, d.op = 'Delete' AS tombstone, t.tip,
  CASE WHEN s.state IN ('Maintenance', 'Retiring', 'Election', 'QuorumLost') THEN s.state WHEN d.key < s.lo OR d.key >= s.hi THEN 'OutOfRange' END AS refused
  FROM deltas d JOIN s ON d.shard = s.shard LEFT JOIN tips t ON d.shard = t.shard WHERE d.seq >= 500)
SELECT shard, arrival, key, op, tombstone, refused,
  CASE WHEN refused IS NULL THEN coalesce(tip, 0) + row_number() OVER (PARTITION BY shard, refused IS NULL ORDER BY arrival) END AS new_seq FROM j
""")
def log_append(spark, d):
    deltas = model.deltas(spark, d)
    shards = spark.createDataFrame([(0, "Active", 0, 80), (1, "Active", 0, 1000000), (2, "Maintenance", 0, 1000000), (3, "Active", 0, 1000000)], "shard long, state string, range_start long, range_end long")
    return log.log_append(deltas.filter("seq < 500"), deltas.filter("seq >= 500").withColumnRenamed("seq", "arrival"), shards)


@query("SELECT min(position) AS boundary FROM consumers")
def gc_boundary(spark, d):
    return log.gc_boundary(model.consumers(spark, d))


@query("SELECT consumer, position, max(position) OVER () - position AS lag FROM consumers QUALIFY lag > 5")
def stalled_consumers(spark, d):
    return log.stalled_consumers(model.consumers(spark, d), 5)


@query("SELECT consumer, max(position) AS position FROM (SELECT consumer, position FROM consumers UNION ALL SELECT consumer, seq FROM deltas) GROUP BY 1")
def consumer_advance(spark, d):
    moves = model.deltas(spark, d).select("consumer", F.col("seq").alias("position"))
    return log.consumer_advance(model.consumers(spark, d), moves, buffered=2**63 - 1)


@query("""
SELECT seq, shard, key, op, tombstone, at_ms, payload_size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM deltas)
WHERE n = 1 AND NOT (tombstone AND seq < (SELECT coalesce(min(position), 0) FROM consumers))
""")
def compact_latest(spark, d):
    kept = log.compact_latest(model.deltas(spark, d), log.gc_boundary(model.consumers(spark, d)))
    return kept.select("seq", "shard", "key", "op", "tombstone", "at_ms", "payload_size")


@query("SELECT seq, key, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM deltas) WHERE n <= 3 AND op <> 'Delete'")
def compact_versions(spark, d):
    return log.compact_versions(model.deltas(spark, d), 3).select("seq", "key", "op")


@query("SELECT seq, key, op FROM deltas WHERE seq >= (SELECT coalesce(min(position), 0) FROM consumers)")
def truncate_log(spark, d):
    return log.truncate_log(model.deltas(spark, d), log.gc_boundary(model.consumers(spark, d))).select("seq", "key", "op")


@query("SELECT shard, count(*) FILTER (op = 'Delete') AS deletes, count(*) AS total, count(*) FILTER (op = 'Delete') * 1000 >= count(*) * 300 AS needed FROM deltas GROUP BY 1")
def needs_compaction(spark, d):
    return log.needs_compaction(model.deltas(spark, d))


@query("SELECT shard, count(*) AS delta_count, sum(payload_size + 128)::BIGINT AS byte_size FROM deltas GROUP BY 1")
def shard_sizes(spark, d):
    return log.shard_sizes(model.deltas(spark, d))


@query("SELECT shard, seq, expected FROM (SELECT shard, seq, lag(seq) OVER (PARTITION BY shard ORDER BY seq) + 1 AS expected FROM deltas WHERE op <> 'Delete') WHERE expected <> seq")
def seq_gap(spark, d):
    return log.seq_gap(model.deltas(spark, d).filter("op <> 'Delete'"))


@query("SELECT shard, arg_min(expected, seq) AS expected, min(seq) AS found FROM (SELECT shard, seq, lag(seq) OVER (PARTITION BY shard ORDER BY seq) + 1 AS expected FROM deltas) WHERE expected <> seq GROUP BY 1")
def first_gap(spark, d):
    return log.first_gap(model.deltas(spark, d))


@query("SELECT key AS peer, max(seq) FILTER (seq % 3 = 0) AS last_seq, min(seq) AS expected, CASE WHEN max(seq) FILTER (seq % 3 = 0) IS NULL THEN min(seq) > 0 ELSE max(seq) FILTER (seq % 3 = 0) + 1 <> min(seq) END AS gap FROM deltas GROUP BY 1")
def cdc_gap_check(spark, d):
    states = model.deltas(spark, d).groupBy(F.col("key").alias("peer")).agg(F.max(F.when(F.col("seq") % 3 == 0, F.col("seq"))).alias("last_seq"), F.min("seq").alias("expected"))
    return log.cdc_gap_check(states)
