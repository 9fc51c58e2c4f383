"""Queries over incremental views, streams and backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.sources import backup, model, shared
from deltaloom.streaming import view as v

from .registry import query

_CURSORS = [("a", 0, 100), ("a", 1, 300), ("b", 2, 5000), ("c", 3, 9999), ("c", 0, 40)]


@query("""
, cur(view_, shard, position) AS (VALUES ('a', 0, 100), ('a', 1, 300), ('b', 2, 5000), ('c', 3, 9999), ('c', 0, 40)),
s AS (SELECT view_, cur.shard, position, max(seq) FILTER (seq > position AND seq <= position + 1000) AS top FROM cur LEFT JOIN deltas ON cur.shard = deltas.shard GROUP BY 1, 2, 3)
SELECT view_ AS "view", min(coalesce(top, position))::BIGINT AS position FROM s GROUP BY 1
""")
def view_poll(spark, d):
    return v.view_poll(model.deltas(spark, d), spark.createDataFrame(_CURSORS, "view string, shard long, position long"))


@query("""
, x AS (SELECT key, min(seq) AS position, ['Building', 'Active', 'Discarded'][1 + key % 3] AS state, CASE WHEN key % 4 <> 0 THEN max(seq) END AS dest FROM deltas GROUP BY 1)
SELECT key AS "view", CASE WHEN state = 'Discarded' THEN position ELSE greatest(position, coalesce(dest, position)) END AS position,
 CASE WHEN state = 'Building' AND greatest(position, coalesce(dest, position)) > 0 THEN 'Active' ELSE state END AS state, state = 'Discarded' AND dest IS NOT NULL AS refused FROM x
""")
def view_advance(spark, d):
    states = F.array(*map(F.lit, ("Building", "Active", "Discarded")))
    per = model.deltas(spark, d).groupBy(F.col("key").alias("view")).agg(F.min("seq").alias("position"), F.max("seq").alias("to"))
    views = per.select("view", "position", F.element_at(states, (F.col("view") % 3 + 1).cast("int")).alias("state"))
    return v.view_advance(views, per.filter("view % 4 <> 0").select("view", F.col("to").alias("position")))


def _project(events):
    op = F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "signup", "Create").otherwise("Update")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"))


def _log(spark, d) -> str:
    """The events as a log folder of several files, which a file stream takes in one by one."""
    path = shared.shared_dir(spark, "log") + "/events"
    model.table(spark, d, "events").repartitionByRange(3, "event_id").write.parquet(path)
    return path


@query("SELECT key, seq, op FROM deltas QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def view_lifecycle(spark, d):
    """Built from the log as a stream, discarded, and built again."""
    view = v.View(spark, shared.shared_dir(spark, "view"), _project)
    schema = model.table(spark, d, "events").schema
    log = _log(spark, d)
    view.poll(log, schema)
    view.discard()
    view.poll(log, schema)
    return view.read().select("key", "seq", "op")


@query("SELECT count(*) AS deltas, count(DISTINCT key) AS chunks FROM deltas")
def chunk_and_delta(spark, d):
    root = shared.shared_dir(spark, "atomic")
    stream = spark.readStream.schema(model.table(spark, d, "events").schema).parquet(_log(spark, d))
    v.append_chunks_and_deltas(spark, stream, lambda b: _project(b).select("key").distinct(), _project, root)
    chunks = spark.read.parquet(f"{root}/chunks").agg(F.count_distinct("key").alias("chunks"))
    return spark.read.parquet(f"{root}/deltas").agg(F.count("*").alias("deltas")).crossJoin(F.broadcast(chunks))


@query("SELECT ref, chunk_id, size FROM chunk_refs")
def backup_restore(spark, d):
    return backup.round_trip(spark, model.chunk_refs(spark, d).select("ref", "chunk_id", "size"))


@query("SELECT 1::BIGINT AS backups, 'new' AS kept")
def backup_cleanup(spark, d):
    b = backup.Backups(spark, shared.shared_dir(spark, "backups"))
    table = model.orgs(spark, d)
    b.snapshot("old", 1_000_000, {"orgs": table})
    b.snapshot("new", 2_000_000, {"orgs": table})
    b.cleanup(2_000_001, 3)
    return b.list().agg(F.count("*").alias("backups"), F.max("id").alias("kept"))
