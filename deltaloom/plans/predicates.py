"""Queries that filter and judge rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import predicates as p
from deltaloom.sources import model

from .registry import query

NOW = 1_706_659_200_000  # 2024-01-31 00:00:00 UTC


def _audit(spark, d):
    return model.history(spark, d).select(F.col("id").alias("seq"), F.when(F.col("source") % 10 == 0, None).otherwise(F.concat(F.lit("t"), (F.col("source") % 10).cast("string"))).alias("tenant"), F.col("category").alias("kind"), "at_ms")


_AUDIT = ", audit AS (SELECT id AS seq, CASE WHEN source % 10 <> 0 THEN 't' || (source % 10) END AS tenant, category AS kind, at_ms FROM history) "


@query(_AUDIT + "SELECT * FROM audit WHERE tenant IS NULL AND seq >= 100 AND kind = 'error' ORDER BY seq LIMIT 50")
def audit_query(spark, d):
    return p.audit_query(_audit(spark, d), None, 100, "error", 50)


@query(_AUDIT + "SELECT * FROM audit WHERE tenant = 't3'")
def audit_export(spark, d):
    return p.audit_query(_audit(spark, d), "t3")


@query(f"SELECT id, severity, category FROM history WHERE at_ms >= {NOW} - 240 * 3600000 AND severity = 'critical'")
def event_query(spark, d):
    return p.event_query(model.history(spark, d), NOW, 240, "critical").select("id", "severity", "category")


_KINDS = {"error": "device", "view": "gateway", "click": "raft"}


@query(f"""
, e AS (SELECT id, at_ms, CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} ELSE category END AS category, CASE WHEN category = 'error' AND id % 2 = 0 THEN 'error' ELSE severity END AS severity FROM history WHERE at_ms >= {NOW} - 240 * 3600000),
u AS (SELECT 'known' AS request, * FROM e WHERE severity = 'error' AND category = 'device' ORDER BY at_ms DESC, id DESC LIMIT 100),
v AS (SELECT 'unknown' AS request, * FROM e ORDER BY at_ms DESC, id DESC LIMIT 100)
SELECT request, id, severity, category, at_ms FROM u UNION ALL SELECT request, id, severity, category, at_ms FROM v
""")
def event_api(spark, d):
    """A request of known names, and one whose names are none of the known ones and so filter nothing."""
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("category")], F.col("category"))
    severity = F.when((F.col("category") == "error") & (F.col("id") % 2 == 0), "error").otherwise(F.col("severity"))
    events = model.history(spark, d).select("id", "at_ms", severity.alias("severity"), kind.alias("category"))
    ask = lambda name, *x: p.event_api(events, NOW, 240, *x).select(F.lit(name).alias("request"), "id", "severity", "category", "at_ms")
    return ask("known", "error", "device").unionByName(ask("unknown", "no such severity", "purchase"))


@query(f"SELECT id, source, amount FROM history WHERE at_ms >= {NOW} - 100 * 3600000")
def history_since(spark, d):
    return p.history_since(model.history(spark, d), NOW, 100).select("id", "source", "amount")


@query("""
, n AS (SELECT ns || '/' || name AS name, md5(id::VARCHAR) AS etag, id FROM names),
r AS (SELECT CASE WHEN id % 2 = 0 THEN name ELSE name || '#' || id END AS name, CASE WHEN id % 3 = 0 THEN '*' END AS if_none_match, CASE WHEN id % 5 = 0 THEN etag WHEN id % 7 = 0 THEN 'x' END AS if_match, id AS request FROM n),
e AS (SELECT name, max(etag) AS etag FROM n GROUP BY 1)
SELECT request, CASE WHEN if_none_match = '*' AND etag IS NOT NULL THEN 'exists' WHEN if_match IS NOT NULL AND etag IS NULL THEN 'missing' WHEN if_match IS NOT NULL AND if_match <> etag THEN 'changed' ELSE 'proceed' END AS verdict
FROM r LEFT JOIN e USING (name)
""")
def write_conditional(spark, d):
    n = model.names(spark, d).select(F.concat_ws("/", "ns", "name").alias("name"), F.md5(F.col("id").cast("string")).alias("etag"), "id")
    requests = n.select(
        F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat_ws("#", "name", "id")).alias("name"), F.when(F.col("id") % 3 == 0, "*").alias("if_none_match"),
        F.when(F.col("id") % 5 == 0, F.col("etag")).when(F.col("id") % 7 == 0, "x").alias("if_match"), F.col("id").alias("request"),
    )
    return p.write_conditional(requests, n.groupBy("name").agg(F.max("etag").alias("etag"))).select("request", "verdict")


@query("SELECT id, source FROM history WHERE source % 10 = 4")
def tenant_isolation(spark, d):
    rows = model.history(spark, d).withColumn("tenant", F.col("source") % 10)
    return rows.filter(F.col("tenant") == 4).select("id", "source")


@query(f"SELECT id, CASE WHEN category = 'purchase' THEN 'Approved' ELSE 'Pending' END = 'Approved' AND {NOW} < at_ms + amount * 3600000 AS active FROM history")
def access_active(spark, d):
    state = F.when(F.col("category") == "purchase", "Approved").otherwise("Pending")
    return model.history(spark, d).select("id", p.access_active(NOW, state, F.col("at_ms"), F.col("amount")).alias("active"))


@query(f"SELECT id, amount % 3 > 0 AND {NOW} - at_ms > (amount % 3) * 86400000 AS expired FROM history")
def ttl_expired(spark, d):
    return model.history(spark, d).select("id", p.ttl_expired(F.lit(NOW) - F.col("at_ms"), (F.col("amount") % 3) * 86400000).alias("expired"))


@query("SELECT id, amount <= 20 AS fresh, amount >= 20 AS key_expired, amount > 20 AS disconnected FROM history")
def cache_fresh(spark, d):
    n = F.col("amount")
    return model.history(spark, d).select("id", p.cache_fresh(n, F.lit(20)).alias("fresh"), p.key_cache_expired(n, F.lit(20)).alias("key_expired"), p.disconnected(n, F.lit(20)).alias("disconnected"))


@query("SELECT id FROM history WHERE amount >= 20", name="key_cache_expired")
def key_cache_expired(spark, d):
    return model.history(spark, d).filter(p.key_cache_expired(F.col("amount"), F.lit(20))).select("id")


@query("SELECT id FROM history WHERE amount > 20", name="disconnected")
def disconnected(spark, d):
    return model.history(spark, d).filter(p.disconnected(F.col("amount"), F.lit(20))).select("id")


@query("SELECT DISTINCT amount, amount BETWEEN 5 AND 300 AS ok FROM history")
def validate_cache_ttl(spark, d):
    return model.history(spark, d).select("amount", p.valid_cache_ttl(F.col("amount")).alias("ok")).distinct()


@query(f"SELECT source, count(*) FILTER ({NOW} - at_ms <= amount * 86400000) AS live, count(*) FILTER ({NOW} - at_ms > amount * 86400000) AS dropped FROM history GROUP BY 1")
def pin_expiry(spark, d):
    pins = model.history(spark, d).groupBy("source").agg(F.collect_list(F.struct(F.col("at_ms").alias("acquired_ms"), (F.col("amount") * 86400000).alias("ttl_ms"))).alias("pins"))
    live = F.size(p.live_pins(F.col("pins"), NOW)).cast("long")
    return pins.select("source", live.alias("live"), (F.size("pins") - live).alias("dropped"))


@query(f"SELECT source, CASE WHEN {NOW} - max(at_ms) > 86400000 THEN {NOW} - max(at_ms) END AS violation FROM history GROUP BY 1")
def staleness_check(spark, d):
    views = model.history(spark, d).groupBy("source").agg(F.max("at_ms").alias("advanced"))
    return views.select("source", p.staleness_lag(NOW, F.col("advanced"), F.lit(86400000)).alias("violation"))


@query("SELECT id, ns FROM names WHERE ns IN (SELECT ns FROM names WHERE id % 7 = 0 AND id % 2 = 0)")
def retention_held(spark, d):
    n = model.names(spark, d)
    holds = n.filter("id % 7 = 0").select("ns", (F.col("id") % 2 == 0).alias("active"))
    return p.retention_held(n, holds).select("id", "ns")


@query("SELECT pool, device, capacity, used, online FROM devices WHERE pool = 3")
def list_devices(spark, d):
    pools = model.devices(spark, d).groupBy("pool").agg(F.collect_list(F.struct("device", "capacity", "used", "online")).alias("devices"))
    return pools.filter("pool = 3").select("pool", F.explode("devices").alias("x")).select("pool", "x.*")


@query("SELECT id FROM history WHERE source IN (SELECT ref FROM chunk_meta WHERE NOT tombstoned)")
def scope_check(spark, d):
    owned = model.chunk_meta(spark, d).filter("not tombstoned").select(F.col("ref").alias("source"))
    return p.in_scope(model.history(spark, d), owned, "source").select("id")


@query("""
, t AS (SELECT p_partkey AS part, (p_size + 49)::BIGINT AS w, (p_partkey % 60 + 45)::BIGINT AS c, (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 40 + 65 END)::BIGINT AS r, (p_partkey % 50 + 45)::BIGINT AS g FROM part)
SELECT part, CASE WHEN w <> 0 AND w NOT BETWEEN 50 AND 95 THEN 'warning' WHEN c <> 0 AND c NOT BETWEEN 60 AND 98 THEN 'critical' WHEN r <> 0 AND r NOT BETWEEN 70 AND 99 THEN 'readonly' WHEN g <> 0 AND g NOT BETWEEN 50 AND 90 THEN 'target'
 WHEN NOT (CASE WHEN w = 0 THEN 70 ELSE w END < CASE WHEN c = 0 THEN 85 ELSE c END AND CASE WHEN c = 0 THEN 85 ELSE c END < CASE WHEN r = 0 THEN 95 ELSE r END) THEN 'order' ELSE 'ok' END AS verdict FROM t
""")
def pool_threshold_check(spark, d):
    k = F.col("p_partkey")
    values = (F.col("p_size") + 49, k % 60 + 45, F.when(k % 3 == 0, 0).otherwise(k % 40 + 65), k % 50 + 45)
    return model.table(spark, d, "part").select(k.alias("part"), p.pool_thresholds(*values).alias("verdict"))


@query("SELECT c.category AS name, c.amount AS value, coalesce(c.amount BETWEEN b.lo AND b.hi, false) AS ok FROM history c LEFT JOIN (VALUES ('view', 1, 50), ('click', 10, 100), ('error', 0, 5)) b(name, lo, hi) ON c.category = b.name")
def tuning_range_check(spark, d):
    bounds = spark.createDataFrame([("view", 1, 50), ("click", 10, 100), ("error", 0, 5)], "name string, lo long, hi long")
    settings = model.history(spark, d).select(F.col("category").alias("name"), F.col("amount").alias("value"))
    return p.tuning_ranges(settings, bounds).select("name", "value", "ok")
