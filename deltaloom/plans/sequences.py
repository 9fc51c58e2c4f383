"""Queries over ordered runs per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import sequences as s
from deltaloom.sources import model

from .registry import query

_READS = ", reads AS (SELECT l_orderkey AS file, l_linenumber::BIGINT AS at, CASE WHEN l_partkey % 5 = 0 THEN 7 ELSE (l_linenumber - 1) * 10 END::BIGINT AS off, 10::BIGINT AS len FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n = 1) "


def _reads(spark, d):
    first = F.min_by("l_partkey", F.struct("l_partkey", "l_suppkey", "l_quantity"))
    reads = model.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first.alias("part"))
    at = F.col("l_linenumber").cast("long")
    return reads.select(F.col("l_orderkey").alias("file"), at.alias("at"), F.when(F.col("part") % 5 == 0, 7).otherwise((at - 1) * 10).cast("long").alias("off"), F.lit(10).cast("long").alias("len"))


@query(_READS + """
, g AS (SELECT *, CASE WHEN off = lag(off + len) OVER w AND lag(len) OVER w > 0 THEN 0 ELSE 1 END AS br FROM reads WINDOW w AS (PARTITION BY file ORDER BY at)),
i AS (SELECT *, sum(br) OVER (PARTITION BY file ORDER BY at) AS island FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY file, island ORDER BY at) AS run FROM i)
SELECT file, at, run, CASE WHEN run >= 3 THEN off + len END AS prefetch_off, CASE WHEN run >= 3 THEN 262144::BIGINT END AS prefetch_len FROM r
""")
def sequential_reads(spark, d):
    return s.sequential_reads(_reads(spark, d))


@query("""
, a AS (SELECT source AS workflow, id AS at, amount AS phase FROM history),
b AS (SELECT *, max(phase) OVER (PARTITION BY workflow ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a),
c AS (SELECT workflow, at, phase FROM b WHERE m IS NULL OR phase > m)
SELECT workflow, at, phase, row_number() OVER (PARTITION BY workflow ORDER BY at DESC) <= 3 AS kept FROM c
""")
def phase_monotonic(spark, d):
    return s.phase_monotonic(model.history(spark, d).select(F.col("source").alias("workflow"), F.col("id").alias("at"), F.col("amount").alias("phase")), 3)


@query("SELECT id, category FROM history QUALIFY row_number() OVER (PARTITION BY category ORDER BY id DESC) <= 100")
def ring_last_n(spark, d):
    return s.ring_last_n(model.history(spark, d).select("id", "category"), "category", "id", 100)


_CALLS = ", calls AS (SELECT source % 5 AS transport, id, at_ms, category IN ('error', 'view') AS failed FROM history), e AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY transport ORDER BY at_ms, id) AS era FROM calls) "


def _calls(spark, d):
    return model.history(spark, d).select((F.col("source") % 5).alias("transport"), "id", "at_ms", F.col("category").isin("error", "view").alias("failed"))


@query(_CALLS + ", f AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY transport, era ORDER BY at_ms RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW) AS failures FROM e) SELECT transport, id, failures, failed AND failures >= 3 AS open FROM f")
def circuit_trip(spark, d):
    return s.circuit_trip(_calls(spark, d), 3_000_000, 3).select("transport", "id", "failures", "open")


@query(_CALLS + ", f AS (SELECT *, sum(failed::INT) OVER (PARTITION BY transport, era ORDER BY at_ms, id)::BIGINT AS streak FROM e) SELECT transport, id, streak, streak >= 3 AS open FROM f")
def breaker_consecutive(spark, d):
    return s.breaker_consecutive(_calls(spark, d)).select("transport", "id", "streak", "open")


@query("""
, w AS (SELECT source AS device, id AS at, CASE category WHEN 'error' THEN 'Offline' WHEN 'view' THEN 'Online' WHEN 'click' THEN 'Draining' ELSE 'Decommissioned' END AS state, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM history),
f(device, k, at, state, before, allowed, held) AS (
 SELECT device, k, at, state, NULL::VARCHAR, true, state FROM w WHERE k = 1
 UNION ALL
 SELECT device, k, at, state, held, ok, CASE WHEN ok THEN state ELSE held END
 FROM (SELECT w.*, f.held, (f.held || '>' || w.state) IN ('Online>Draining', 'Online>Offline', 'Offline>Online', 'Draining>Decommissioned') AS ok FROM f JOIN w ON w.device = f.device AND w.k = f.k + 1))
SELECT device, at, state, before, allowed FROM f WHERE k > 1
""")
def device_transitions(spark, d):
    state = F.when(F.col("category") == "error", "Offline").when(F.col("category") == "view", "Online").when(F.col("category") == "click", "Draining").otherwise("Decommissioned")
    return s.device_transitions(model.history(spark, d).select(F.col("source").alias("device"), F.col("id").alias("at"), state.alias("state")))


@query("""
, e AS (SELECT source % 8 AS cache, id AS entry, at_ms AS at, amount + 1 AS size, id % 400 = 0 AS pinned FROM history),
r AS (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY pinned DESC, at DESC, entry ROWS UNBOUNDED PRECEDING) AS total FROM e)
SELECT cache, entry, size FROM r WHERE pinned OR total <= 2000
""")
def lru_evict(spark, d):
    entries = model.history(spark, d).select((F.col("source") % 8).alias("cache"), F.col("id").alias("entry"), F.col("at_ms").alias("at"), (F.col("amount") + 1).alias("size"), (F.col("id") % 400 == 0).alias("pinned"))
    return s.survivors(entries, 2000).select("cache", "entry", "size")


@query("SELECT source % 8 AS cache, id AS entry FROM history QUALIFY row_number() OVER (PARTITION BY source % 8 ORDER BY at_ms DESC, id DESC) <= 64")
def oldest_evict(spark, d):
    entries = model.history(spark, d).select((F.col("source") % 8).alias("cache"), F.col("id").alias("entry"), "at_ms")
    return s.newest_entries(entries, "cache", "at_ms", "entry", 64).select("cache", "entry")


@query(", c AS (SELECT category AS owner, id, at_ms // 600000 AS second FROM history) SELECT owner, id, second, row_number() OVER (PARTITION BY owner, second ORDER BY id) <= 1 AS admitted FROM c")
def token_bucket(spark, d):
    calls = model.history(spark, d).select(F.col("category").alias("owner"), "id", F.expr("at_ms div 600").alias("at_ms"))
    return s.token_bucket(calls.withColumn("at_ms", F.expr("at_ms div 1000 * 1000")), 1).select("owner", "id", "second", "admitted")


@query("""
, x AS (SELECT DISTINCT source AS volume, (id % 300) * 8 AS off, 8::BIGINT AS len FROM history),
b AS (SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY volume ORDER BY off) = off THEN 0 ELSE 1 END AS br FROM x),
r AS (SELECT *, sum(br) OVER (PARTITION BY volume ORDER BY off) AS run FROM b)
SELECT volume, min(off) AS off, sum(len)::BIGINT AS len, count(*) AS merged FROM r GROUP BY volume, run
""")
def extent_coalesce(spark, d):
    extents = model.history(spark, d).select(F.col("source").alias("volume"), (F.col("id") % 300 * 8).alias("off"), F.lit(8).cast("long").alias("len")).distinct()
    return s.extent_coalesce(extents)


@query("""
, o AS (SELECT source % 5 AS transport, list(amount ORDER BY id) AS v FROM history GROUP BY 1)
SELECT transport, list_reduce(v, lambda acc, x: (x + acc * 4) // 5) AS ema FROM o
""")
def latency_ema(spark, d):
    return s.latency_ema(model.history(spark, d).withColumn("transport", F.col("source") % 5), "transport", "id", "amount")


@query("""
, w AS (SELECT category, id, amount, row_number() OVER (PARTITION BY category ORDER BY id) AS k FROM history),
f(category, k, first, bytes, batch, closed, size, closed2, size2) AS (
 SELECT DISTINCT category, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM history
 UNION ALL
 SELECT category, k, CASE WHEN total >= 500 THEN NULL ELSE start END, CASE WHEN total >= 500 THEN 0 ELSE total END, batch + late::INT + (total >= 500)::INT,
  CASE WHEN late THEN batch END, CASE WHEN late THEN bytes END, CASE WHEN total >= 500 THEN batch + late::INT END, CASE WHEN total >= 500 THEN total END
 FROM (SELECT *, CASE WHEN late THEN amount ELSE bytes + amount END AS total, CASE WHEN late OR first IS NULL THEN id ELSE first END AS start
  FROM (SELECT f.category, w.k, f.first, f.bytes, f.batch, w.id, w.amount, coalesce(w.id - f.first >= 40, false) AS late FROM f JOIN w ON w.category = f.category AND w.k = f.k + 1))),
e AS (SELECT category, closed AS batch, size AS bytes FROM f WHERE closed IS NOT NULL UNION ALL SELECT category, closed2, size2 FROM f WHERE closed2 IS NOT NULL
 UNION ALL SELECT f.category, f.batch, f.bytes FROM f JOIN (SELECT category, max(k) AS k FROM w GROUP BY 1) l ON f.category = l.category AND f.k = l.k WHERE f.first IS NOT NULL)
SELECT category, batch, bytes FROM e
""")
def write_batches(spark, d):
    """Closed at 500 bytes, or before a write 40 ids after the first."""
    return s.write_batches(model.history(spark, d), "category", "id", "amount", 500, 40)


@query("""
, w AS (SELECT source % 8 AS owner, id AS at, category <> 'error' AND amount % 2 = 0 AS declares, row_number() OVER (PARTITION BY source % 8 ORDER BY id) AS k FROM history),
f(owner, k, at, declares, admitted, active) AS (
 SELECT DISTINCT owner, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, NULL::BOOLEAN, 0::BIGINT FROM w
 UNION ALL
 SELECT w.owner, w.k, w.at, w.declares, CASE WHEN w.declares THEN f.active < 3 ELSE f.active > 0 END, CASE WHEN w.declares THEN least(f.active + 1, 3) ELSE greatest(f.active - 1, 0) END
 FROM f JOIN w ON w.owner = f.owner AND w.k = f.k + 1)
SELECT owner, at, declares, admitted, active FROM f WHERE k > 0
""")
def workflow_slots(spark, d):
    h = model.history(spark, d)
    return s.workflow_slots(h.select((F.col("source") % 8).alias("owner"), F.col("id").alias("at"), ((F.col("category") != "error") & (F.col("amount") % 2 == 0)).alias("declares")), 3)


@query("""
, e AS (SELECT source AS node, id AS at, (id * 7919) % 5000 AS physical FROM history),
t AS (SELECT *, max(physical) OVER (PARTITION BY node ORDER BY at) AS top FROM e)
SELECT node, at, top AS physical, row_number() OVER (PARTITION BY node, top ORDER BY at) - 1 AS logical FROM t
""")
def hlc_tick(spark, d):
    return s.hlc_tick(model.history(spark, d).select(F.col("source").alias("node"), F.col("id").alias("at"), (F.col("id") * 7919 % 5000).alias("physical")))


@query("""
, m AS (SELECT id, amount % 20 AS lp, source % 5 AS ll, id % 20 AS rp, id % 7 AS rl, id % 13 AS now_ FROM history)
SELECT id, greatest(lp, rp, now_) AS physical, CASE WHEN greatest(lp, rp, now_) = lp AND lp = rp THEN greatest(ll, rl) + 1 WHEN greatest(lp, rp, now_) = lp THEN ll + 1 WHEN greatest(lp, rp, now_) = rp THEN rl + 1 ELSE 0 END AS logical FROM m
""")
def hlc_merge(spark, d):
    c = lambda p, q: F.struct(p.alias("physical"), q.alias("logical"))
    rows = model.history(spark, d).select("id", c(F.col("amount") % 20, F.col("source") % 5).alias("l"), c(F.col("id") % 20, F.col("id") % 7).alias("r"), (F.col("id") % 13).alias("n"))
    return rows.select("id", s.hlc_merge(F.col("l"), F.col("r"), F.col("n")).alias("m")).select("id", "m.physical", "m.logical")
