"""Queries that join."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltaloom.operators import joins as j
from deltaloom.operators import versions
from deltaloom.sources import model

from .predicates import NOW
from .registry import query


@query("SELECT c.ref, CASE WHEN m.ref IS NOT NULL THEN 'Keep' WHEN c.size * 40000 < 86400000 THEN 'KeepYoung' ELSE 'Delete' END AS decision FROM chunk_refs c LEFT JOIN (SELECT ref FROM chunk_meta WHERE NOT tombstoned) m ON c.ref = m.ref")
def orphan_scrub(spark, d):
    local = model.chunk_refs(spark, d).select("ref", (F.col("size") * 40000).alias("age_ms"))
    return j.orphan_scrub(local, model.chunk_meta(spark, d))


_HEALTH = """
, placement AS (SELECT ref AS chunk, i AS pos, (ref + i * 3) % 7 AS peer FROM chunk_refs, (VALUES (0), (1), (2)) v(i)),
here AS (SELECT chunk, pos, peer, NOT ((chunk * 31 + peer * 17) % 5 < 2) AS here FROM placement),
h AS (SELECT chunk, count(*) AS width, count(*) FILTER (here) AS healthy, arg_min(peer, pos) FILTER (here) AS source, arg_min(peer, pos) FILTER (NOT here) AS missing, array_agg(peer ORDER BY pos) FILTER (here) AS sources FROM here GROUP BY 1),
v AS (SELECT *, CASE WHEN healthy = 0 THEN 'Lost' WHEN healthy < 2 THEN 'Critical' WHEN healthy < 3 AND healthy < width THEN 'Repair' ELSE 'Healthy' END AS verdict FROM h)
"""


def _health(spark, d):
    refs = model.chunk_refs(spark, d).select(F.col("ref").alias("chunk"))
    placement = refs.select("chunk", F.array(*((F.col("chunk") + i * 3) % 7 for i in range(3))).alias("peers"))
    presence = placement.select("chunk", F.explode("peers").alias("peer")).filter(~((F.col("chunk") * 31 + F.col("peer") * 17) % 5 < 2))
    return j.replica_health(placement, presence, 3, 2)


@query(_HEALTH + "SELECT chunk, width, healthy, verdict FROM v")
def under_replication(spark, d):
    return _health(spark, d).select("chunk", "width", "healthy", "verdict")


@query(_HEALTH + "SELECT chunk, source AS \"from\", missing AS \"to\" FROM v WHERE verdict IN ('Critical', 'Repair')")
def repair_plan(spark, d):
    return j.repair_plan(_health(spark, d))


@query(_HEALTH + "SELECT chunk, array_to_string(sources, ',') AS \"from\", missing AS \"to\" FROM v WHERE verdict IN ('Critical', 'Repair')")
def repair_plan_ec(spark, d):
    return j.repair_plan_ec(_health(spark, d)).withColumn("from", F.array_join(F.transform("from", lambda x: x.cast("string")), ","))


@query("SELECT coalesce(a.e, r.e) AS extent, CASE WHEN r.e IS NULL THEN 'orphan' ELSE 'unallocated' END AS fault FROM (SELECT ref AS e FROM chunk_refs) a FULL JOIN (SELECT ref AS e FROM chunk_meta) r ON a.e = r.e WHERE a.e IS NULL OR r.e IS NULL")
def extent_orphans(spark, d):
    allocated = model.chunk_refs(spark, d).select(F.col("ref").alias("extent"))
    return j.extent_orphans(allocated, model.chunk_meta(spark, d).select(F.col("ref").alias("extent")))


@query("""
, e AS (SELECT source % 8 AS device, row_number() OVER (PARTITION BY source % 8 ORDER BY id) - 1 AS extent, (amount % 4 <> 0)::INT AS prim, (amount % 4 <> 0 AND amount % 9 <> 5)::INT AS mirr, amount % 5 <> 2 AS crc_ok, category <> 'error' AS held FROM history),
n AS (SELECT *, count(*) OVER (PARTITION BY device) AS n FROM e)
SELECT device, count(*) FILTER (prim <> mirr) AS bitmap_errors, count(*) FILTER (prim = 1 AND NOT held) AS orphan_extents,
 count(*) FILTER (prim = 1 AND (extent::HUGEINT * 2654435761) % n * 1000 < n * 250 AND NOT crc_ok) AS crc_failures, count(*) AS extents_checked FROM n GROUP BY 1
""")
def extent_scrub(spark, d):
    order = Window.partitionBy("device").orderBy("id")
    h = model.history(spark, d).withColumn("device", F.col("source") % 8).withColumn("extent", (F.row_number().over(order) - 1).cast("long"))
    used, ok = F.col("amount") % 4 != 0, F.col("amount") % 9 != 5
    extents = h.select("device", "extent", used.cast("int").alias("primary"), (used & ok).cast("int").alias("mirror"), (F.col("amount") % 5 != 2).alias("crc_ok"))
    return j.extent_scrub(extents, h.filter("category <> 'error'").select("device", "extent"), 250)


@query("SELECT n.name, n.id, c.size FROM names n JOIN chunk_refs c ON n.id = c.ref WHERE c.tenant = 'src1'")
def named_object_join(spark, d):
    objects = model.chunk_refs(spark, d).filter("tenant = 'src1'").select(F.col("ref").alias("id"), F.col("size").alias("object_size"))
    return model.names(spark, d).join(objects, "id").select("name", "id", F.col("object_size").alias("size"))


@query("SELECT ref FROM chunk_refs WHERE ref NOT IN (SELECT id FROM names)")
def unnamed_anti(spark, d):
    return model.chunk_refs(spark, d).join(model.names(spark, d).select(F.col("id").alias("ref")), "ref", "left_anti").select("ref")


@query(", r(shard, a, b, last) AS (VALUES (0, 0, 40, false), (1, 40, 75, false), (2, 75, 120, false), (3, 120, 140, true)) SELECT d.seq, d.key, r.shard::BIGINT AS owner FROM deltas d JOIN r ON d.key >= r.a AND (d.key < r.b OR r.last)")
def route_to_shard(spark, d):
    ranges = model.ranges(spark, [0, 40, 75, 120, 140]).withColumnRenamed("shard", "owner")
    return j.route_to_shard(model.deltas(spark, d), ranges).select("seq", "key", "owner")


@query("""
, first AS (SELECT key, min(seq) AS s FROM deltas WHERE op <> 'Delete' GROUP BY 1),
chain AS (SELECT d.key, d.seq, d.at_ms, d.tombstone AS deleted, row_number() OVER (PARTITION BY d.key ORDER BY d.seq) AS version FROM deltas d JOIN first f ON d.key = f.key AND d.seq >= f.s),
probes AS (SELECT id AS probe, source AS key, at_ms + 3600000 - (id % 7) * 86400000 AS at_ms FROM history),
late AS (SELECT key, seq, deleted, version, at_ms + (version % 3) * 90000000 AS at_ms FROM chain)
SELECT p.probe, p.key, CASE WHEN NOT b.deleted THEN b.version END AS version, CASE WHEN NOT b.deleted THEN b.seq END AS seq
FROM probes p LEFT JOIN LATERAL (SELECT * FROM late c WHERE c.key = p.key AND c.at_ms <= p.at_ms ORDER BY c.version DESC LIMIT 1) b ON true
""")
def version_at_time(spark, d):
    """Versions are given times that do not rise with them."""
    at = F.col("at_ms") + 3600000 - F.col("id") % 7 * 86400000
    probes = model.history(spark, d).select(F.col("id").alias("probe"), F.col("source").alias("key"), at.alias("at_ms"))
    chain = versions.version_chain(model.deltas(spark, d))
    return j.version_at_time(probes, chain.withColumn("at_ms", F.col("at_ms") + F.col("version") % 3 * 90000000))


@query("SELECT w.workload, p.project_name, o.org_name FROM workload w LEFT JOIN project p ON w.project = p.project LEFT JOIN org o ON p.org = o.org")
def hierarchy_join(spark, d):
    return j.hierarchy(model.workloads(spark, d), model.projects(spark, d), model.orgs(spark, d)).select("workload", "project_name", "org_name")


@query("SELECT h.id, m.ref IS NOT NULL AS found, m.tombstoned FROM history h LEFT JOIN chunk_meta m ON h.source = m.ref")
def advisory_lookup(spark, d):
    meta = model.chunk_meta(spark, d).select(F.col("ref").alias("source"), "tombstoned", F.lit(True).alias("f"))
    return model.history(spark, d).join(meta, "source", "left").select("id", F.coalesce("f", F.lit(False)).alias("found"), "tombstoned")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN h.category = 'view' THEN 'absent' WHEN m.ref IS NOT NULL THEN 'valid' ELSE 'invalid' END AS outcome FROM history h LEFT JOIN chunk_meta m ON h.source = m.ref) GROUP BY 1")
def workflow_ref_outcome(spark, d):
    requests = model.history(spark, d).select(F.when(F.col("category") != "view", F.col("source")).alias("ref"))
    return j.ref_outcome(requests, model.chunk_meta(spark, d))


@query(f"""
, l AS (SELECT *, CASE WHEN len = 0 THEN 4611686018427387904 ELSE off + len END AS stop FROM locks)
SELECT a.file, a.lock_id AS request, b.lock_id AS holder FROM l a JOIN l b ON a.file = b.file AND a.off < b.stop AND b.off < a.stop AND a.owner <> b.owner AND (a.write_lock OR b.write_lock)
WHERE {NOW} - b.acquired_ms <= 1000000000
""")
def lock_conflicts(spark, d):
    locks = model.locks(spark, d)
    return j.lock_conflicts(locks, locks, NOW, 1_000_000_000)


@query("SELECT a.lock_id, coalesce(lo <= off AND hi >= off + greatest(len, 1), false) AS covers FROM locks a LEFT JOIN (SELECT file, min(off) AS lo, max(off + len) AS hi FROM locks WHERE write_lock GROUP BY 1) s USING (file)")
def layout_covers(spark, d):
    locks = model.locks(spark, d)
    return j.layout_covers(locks.filter("write_lock").select("file", "off", "len"), locks).select("lock_id", "covers")


@query("SELECT project AS pool FROM project WHERE project NOT IN (SELECT pool FROM devices)")
def pool_delete_guard(spark, d):
    pools = model.projects(spark, d).select(F.col("project").alias("pool"))
    return j.pool_delete_guard(pools, model.devices(spark, d))
