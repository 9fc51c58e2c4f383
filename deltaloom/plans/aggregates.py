"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import aggregates as a
from deltaloom.sources import model

from .predicates import NOW
from .registry import query


@query(f"""
, n AS (SELECT source AS node, max(at_ms) AS at_ms, count(*) AS ops, sum(amount)::BIGINT AS bytes, count(*) FILTER (category = 'error') AS errors FROM history GROUP BY 1)
SELECT sum(ops)::BIGINT AS ops, sum(bytes)::BIGINT AS bytes, sum(errors)::BIGINT AS errors, count(*) AS nodes, count(*) FILTER (({NOW} - at_ms) * 2 <= 3 * 43200000) AS healthy FROM n
""")
def cluster_summary(spark, d):
    nodes = model.history(spark, d).groupBy(F.col("source").alias("node")).agg(F.max("at_ms").alias("at_ms"), F.count("*").alias("ops"), F.sum("amount").alias("bytes"), F.count_if(F.col("category") == "error").alias("errors"))
    return a.cluster_summary(nodes, NOW, 43_200_000)


@query("SELECT sum(capacity)::BIGINT AS capacity, sum(used)::BIGINT AS used, count(*) AS devices, count(*) FILTER (online) AS online FROM devices")
def capacity_status(spark, d):
    return a.capacity_status(model.devices(spark, d))


@query("SELECT device, CASE WHEN used * 100 // capacity >= 95 THEN 'readonly' WHEN used * 100 // capacity >= 85 THEN 'critical' WHEN used * 100 // capacity >= 70 THEN 'warning' ELSE 'ok' END AS state FROM devices")
def pool_state(spark, d):
    return model.devices(spark, d).select("device", a.pool_state(F.col("used"), F.col("capacity")).alias("state"))


@query("SELECT severity, count(*) AS n FROM history GROUP BY 1")
def events_by_severity(spark, d):
    return model.history(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


_CHANGES = ", c AS (SELECT key AS chunk, seq AS at, CASE WHEN op = 'Delete' THEN -1 ELSE 1 END AS delta FROM deltas) "


def _changes(spark, d):
    return model.deltas(spark, d).select(F.col("key").alias("chunk"), F.col("seq").alias("at"), F.when(F.col("op") == "Delete", -1).otherwise(1).cast("long").alias("delta"))


@query(_CHANGES + "SELECT chunk, greatest(sum(delta), 0)::BIGINT AS refcount, sum(delta) < 0 AS underflow FROM c GROUP BY 1")
def refcount(spark, d):
    return a.refcount(_changes(spark, d))


@query(_CHANGES + """, r AS (SELECT chunk, at, delta, sum(delta) OVER (PARTITION BY chunk ORDER BY at ROWS UNBOUNDED PRECEDING) AS raw FROM c),
m AS (SELECT *, raw - least(min(raw) OVER (PARTITION BY chunk ORDER BY at ROWS UNBOUNDED PRECEDING), 0) AS n FROM r)
SELECT chunk, at, delta::BIGINT AS delta, n::BIGINT AS count, n = 0 AS tombstoned FROM m""")
def refcount_history(spark, d):
    return a.refcount_history(_changes(spark, d))


@query("""
, t AS (SELECT pool, max(CASE WHEN used > 9990 THEN 1 ELSE 0 END) AS over_, min(greatest(capacity - used, 0)) AS room FROM devices GROUP BY pool)
SELECT pool, (CASE WHEN over_ = 1 THEN 128 ELSE least(greatest(room // 2, 128), 65536) END)::BIGINT AS threshold, CASE WHEN over_ = 1 THEN 'hard_limit' WHEN room // 2 < 128 THEN 'floor' WHEN room // 2 > 65536 THEN 'ceiling' ELSE 'computed' END AS reason FROM t
""")
def inline_threshold(spark, d):
    """One threshold per pool: some have a node over its limit."""
    nodes = model.devices(spark, d).select("pool", F.col("capacity").alias("total"), "used", F.lit(9990).alias("hard"))
    return a.inline_threshold(nodes, 2, by=("pool",))


@query("SELECT conv_id AS upload, sum(strlen(text))::BIGINT AS size, count(*) AS parts FROM conversations GROUP BY 1")
def multipart_size(spark, d):
    return model.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("upload")).agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count("*").alias("parts"))


@query("SELECT tenant AS dataset, sum(size)::BIGINT AS bytes, count(*) AS chunks FROM chunk_refs GROUP BY 1")
def staged_bytes(spark, d):
    return model.chunk_refs(spark, d).groupBy(F.col("tenant").alias("dataset")).agg(F.sum("size").alias("bytes"), F.count("*").alias("chunks"))


@query("SELECT l_orderkey AS upload, sum(l_quantity::BIGINT)::BIGINT AS size, count(*) AS parts, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_partkey, l_linenumber, l_quantity) AS \"order\" FROM lineitem GROUP BY 1")
def multipart_assemble(spark, d):
    arrival = F.struct("l_partkey", "l_linenumber", "l_quantity")
    parts = model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("part"), F.col("l_quantity").cast("long").alias("size"), arrival.alias("arrival"))
    return a.multipart_assemble(parts)


@query("SELECT shard, count(*) AS events, max(seq) AS tip FROM deltas GROUP BY 1")
def total_events(spark, d):
    return model.deltas(spark, d).groupBy("shard").agg(F.count("*").alias("events"), F.max("seq").alias("tip"))


@query("SELECT project AS \"group\", CASE WHEN count(DISTINCT workload % 12) < 5 THEN -1.0 ELSE max(quota)::DOUBLE END AS saturation FROM workload GROUP BY 1")
def kanon_saturation(spark, d):
    rows = model.workloads(spark, d).select(F.col("project").alias("group"), (F.col("workload") % 12).alias("member"), F.col("quota").alias("value"))
    return a.kanon_saturation(rows)


@query("SELECT conv_id % 10 AS owner, count(DISTINCT conv_id) AS active FROM conversations GROUP BY 1")
def workflow_active_count(spark, d):
    return model.table(spark, d, "conversations").groupBy((F.col("conv_id") % 10).alias("owner")).agg(F.count_distinct("conv_id").alias("active"))


@query("SELECT ns, count(*) AS n FROM names GROUP BY 1")
def names_count(spark, d):
    return model.names(spark, d).groupBy("ns").agg(F.count("*").alias("n"))


@query("""
, s AS (SELECT category, array_agg(amount ORDER BY amount) AS v, count(*) AS n FROM history GROUP BY 1)
SELECT category, n, v[1 + least(n * 50 // 100, n - 1)] AS p50, v[1 + least(n * 95 // 100, n - 1)] AS p95, v[1 + least(n * 99 // 100, n - 1)] AS p99 FROM s
""")
def latency_percentiles(spark, d):
    return a.latency_percentiles(model.history(spark, d), "category", "amount")


_SKEW = ", k AS (SELECT source AS peer, id AS at, amount * 70 AS local, (id * 37) % 4000 AS remote FROM history) "


def _skew(spark, d):
    return model.history(spark, d).select(F.col("source").alias("peer"), F.col("id").alias("at"), (F.col("amount") * 70).alias("local"), ((F.col("id") * 37) % 4000).alias("remote"))


@query(_SKEW + ", m AS (SELECT peer, at, max(abs(local - remote)) OVER (PARTITION BY peer ORDER BY at ROWS 4 PRECEDING) AS skew FROM k) SELECT peer, at, skew, CASE WHEN skew > 5000 THEN 'hard' WHEN skew > 500 THEN 'soft' ELSE 'ok' END AS level FROM m")
def max_clock_skew(spark, d):
    return a.max_clock_skew(_skew(spark, d), 5).select("peer", "at", "skew", "level")


@query(_SKEW + "SELECT peer, max(abs(local - remote)) AS skew FROM k GROUP BY 1")
def skew_by_peer(spark, d):
    return _skew(spark, d).groupBy("peer").agg(F.max(F.abs(F.col("local") - F.col("remote"))).alias("skew")).orderBy("peer")


@query("SELECT pool, count(*) FILTER (used > 3000) AS active FROM devices GROUP BY 1")
def active_peers(spark, d):
    status = F.when(F.col("used") > 6000, "Active").when(F.col("used") > 3000, "Syncing").otherwise("Offline")
    return model.devices(spark, d).groupBy("pool").agg(F.count_if(status.isin("Active", "Syncing")).alias("active"))


@query("SELECT device, capacity * 60 // 100 AS soft, capacity * 80 // 100 AS hard, greatest(capacity * 60 // 100 - used, 0)::BIGINT AS budget FROM devices")
def metadata_budget(spark, d):
    return model.devices(spark, d).select("device", *a.metadata_budget(F.col("capacity"), F.col("used"), 60, 80))


@query("""
, t AS (SELECT o_custkey % 50 AS job, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'open' END AS state, o_orderkey % 997 = 0 AS cancelled FROM orders)
SELECT job, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) AS total, bool_or(cancelled) AS cancelled,
 bool_or(cancelled) OR count(*) FILTER (state = 'completed') + count(*) FILTER (state = 'failed') >= count(*) AS done FROM t GROUP BY 1
""")
def rewrap_progress(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("open")
    return a.progress(model.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("job"), state.alias("state"), (F.col("o_orderkey") % 997 == 0).alias("cancelled")), "job")


@query("SELECT pool, count(*) FILTER (NOT online) AS completed, count(*) AS total, CASE WHEN count(*) FILTER (NOT online) >= count(*) THEN 'Evicted' ELSE 'Draining' END AS state FROM devices GROUP BY 1")
def drain_progress(spark, d):
    out = model.devices(spark, d).groupBy("pool").agg(F.count_if(~F.col("online")).alias("completed"), F.count("*").alias("total"))
    return out.withColumn("state", F.when(F.col("completed") >= F.col("total"), "Evicted").otherwise("Draining"))


@query("SELECT id, CASE WHEN amount > 24 THEN 'ProceedWithGap' ELSE 'Defer' END AS valve, category = 'error' AND amount > 24 AS backpressure FROM history")
def audit_valves(spark, d):
    stalled = F.col("amount") > 24
    return model.history(spark, d).select("id", F.when(stalled, "ProceedWithGap").otherwise("Defer").alias("valve"), ((F.col("category") == "error") & stalled).alias("backpressure"))


@query("SELECT category, count(*) FILTER (amount <= 10) AS le_10, count(*) FILTER (amount <= 50) AS le_50, count(*) FILTER (amount <= 100) AS le_100, count(*) AS count, sum(amount)::BIGINT AS sum FROM history GROUP BY 1")
def latency_histogram(spark, d):
    return a.histogram(model.history(spark, d), "category", "amount", [10, 50, 100])


@query("SELECT project AS node, project AS raft_entries, (project * 10) AS bytes_written, (project + 7) AS requests FROM project")
def metrics_text_scan(spark, d):
    k = F.col("project")
    lines = F.concat_ws("\n", F.lit("# HELP entries"), F.concat(F.lit("raft_entries "), k), F.lit(""), F.concat(F.lit("bytes_written "), k * 10), F.concat(F.lit('requests_total{op="get"} '), k), F.lit('requests_total{op="put"} 7'))
    texts = model.projects(spark, d).select(k.alias("node"), lines.alias("text"))
    return a.metrics_text_scan(texts, {"raft_entries": "raft_entries", "bytes_written": "bytes_written"}, {"requests": "requests_total"})
