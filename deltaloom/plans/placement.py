"""Queries about placement and range partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import placement as p
from deltaloom.sources import model

from .registry import query


def _chunks(spark, d):
    return model.chunk_refs(spark, d).select(F.col("ref").alias("chunk"))


@query(", n(node) AS (VALUES (1), (2), (3), (4), (5), (6), (7)), s AS (SELECT ref AS chunk, node, row_number() OVER (PARTITION BY ref ORDER BY md5(ref || ':' || node) DESC, node) - 1 AS rank FROM chunk_refs, n) SELECT chunk, rank, node::BIGINT AS node FROM s WHERE rank < 3")
def rendezvous_topk(spark, d):
    return p.rendezvous_topk(_chunks(spark, d), list(range(1, 8)), 3)


_DEVICES = [bytes([17 * i % 251]) * 16 for i in range(1, 10)]
_MIX = f"lambda h, b: (xor(h, b) * {p.FNV_FACTOR}::UHUGEINT) % 18446744073709551616::UHUGEINT"
_BYTES = "list_transform(range(32), lambda i: ('0x' || substr(chunk_id, 2 * i::INT + 1, 2))::UHUGEINT)"


def _crush_sql(total: int, data: int) -> str:
    """Fragment after fragment takes the best of the devices that the ones before have left."""
    devices = ", ".join(f"({i}, {x[0]})" for i, x in enumerate(_DEVICES))
    steps = ["p0 AS (SELECT DISTINCT chunk, []::BIGINT[] AS used FROM s)"]
    for f in range(total):
        steps.append(f"p{f + 1} AS (SELECT p.chunk, list_append(any_value(used), arg_max(dev, (score, -dev))) AS used FROM p{f} p JOIN s ON s.chunk = p.chunk AND s.f = {f} AND NOT list_contains(used, dev) GROUP BY p.chunk)")
    return f"""
, dv(dev, b) AS (VALUES {devices}), h AS (SELECT ref AS chunk, list_reduce(list_concat([{p.FNV_START}::UHUGEINT], {_BYTES}), {_MIX}) AS h FROM chunk_refs),
g AS (SELECT chunk, f, list_reduce([h, f::UHUGEINT, 0::UHUGEINT, 0::UHUGEINT, 0::UHUGEINT], {_MIX}) AS h FROM h, range({total}) r(f)),
s AS (SELECT chunk, f, dev::BIGINT AS dev, list_reduce(list_concat([h], list_transform(range(16), lambda i: b::UHUGEINT)), {_MIX}) AS score FROM g, dv),
{", ".join(steps)}
SELECT chunk, unnest(range({total})) AS fragment, unnest(used) AS device, unnest(list_transform(range({total}), lambda i: i >= {data})) AS parity FROM p{total}
"""


def _place_sql(online: int, n: int) -> str:
    steps = [f"p0 AS (SELECT chunk, seed, list_transform(range(1, {online + 1}), lambda i: i::BIGINT) AS rest, []::BIGINT[] AS took FROM s)"]
    for i in range(n):
        at = f"((seed * {p.SEED_FACTOR}::UHUGEINT + {i}) % 18446744073709551616::UHUGEINT % {online - i}::UHUGEINT)::BIGINT"
        steps.append(f"p{i + 1} AS (SELECT chunk, seed, list_concat(list_slice(rest, 1, {at}), list_slice(rest, {at} + 2, {online})) AS rest, list_append(took, rest[{at} + 1]) AS took FROM p{i})")
    return f"""
, s AS (SELECT ref AS chunk, list_reduce(list_transform(range(8), lambda i: ('0x' || substr(chunk_id, 15 - 2 * i::INT, 2))::UHUGEINT), lambda a, b: a * 256::UHUGEINT + b) AS seed FROM chunk_refs),
{", ".join(steps)}
SELECT chunk, unnest(range({n})) AS fragment, unnest(took) AS device FROM p{n}
"""


def _hashed(spark, d):
    return model.chunk_refs(spark, d).select(F.col("ref").alias("chunk"), "chunk_id")


@query(_crush_sql(6, 4))
def crush_assign(spark, d):
    return p.crush_assign(_hashed(spark, d), _DEVICES, 4, 2)


@query(_place_sql(9, 6))
def place_fragments(spark, d):
    return p.place_fragments(_hashed(spark, d), list(range(1, 10)), 6)


_OFFERS = [(0, "small-tcp", "tcp"), (1, "big-rdma", "rdma"), (2, "big-tcp", "tcp"), (3, "view", "ib")]


@query("""
, o(pos, name, transport) AS (VALUES (0, 'small-tcp', 'tcp'), (1, 'big-rdma', 'rdma'), (2, 'big-tcp', 'tcp'), (3, 'view', 'ib')),
r AS (SELECT id AS request, category AS name, CASE id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'rdma' ELSE 'none' END AS transport FROM history)
SELECT request, arg_min(o.name, (r.name <> o.name)::INT * 100 + pos) AS offer FROM r LEFT JOIN o ON r.name = o.name OR r.transport = o.transport GROUP BY 1
""")
def match_flavor(spark, d):
    transport = F.when(F.col("id") % 3 == 0, "tcp").when(F.col("id") % 3 == 1, "rdma").otherwise("none")
    requests = model.history(spark, d).select(F.col("id").alias("request"), F.col("category").alias("name"), transport.alias("transport"))
    return p.match_flavor(requests, spark.createDataFrame(_OFFERS, "pos long, name string, transport string"))


@query("""
, q(pos, pool, kind) AS (VALUES (0, 'cold', 'hdd'), (1, 'fast', 'nvme'), (2, 'mid', 'ssd'), (3, 'mix', 'mixed')),
o AS (SELECT ref AS object, size * 30 AS size, CASE WHEN ref % 4 = 0 THEN 'ssd' WHEN ref % 4 = 1 THEN 'tape' END AS prefer FROM chunk_refs)
SELECT object, arg_min(pool, CASE WHEN kind = prefer THEN 0 WHEN (size < 65536 AND kind IN ('nvme', 'ssd')) OR (size >= 65536 AND kind IN ('hdd', 'mixed')) THEN 1 ELSE 2 END * 100 + pos) AS pool FROM o, q GROUP BY 1
""")
def select_pool(spark, d):
    pools = spark.createDataFrame([(0, "cold", "hdd"), (1, "fast", "nvme"), (2, "mid", "ssd"), (3, "mix", "mixed")], "pos long, pool string, kind string")
    prefer = F.when(F.col("ref") % 4 == 0, "ssd").when(F.col("ref") % 4 == 1, "tape")
    return p.select_pool(model.chunk_refs(spark, d).select(F.col("ref").alias("object"), (F.col("size") * 30).alias("size"), prefer.alias("prefer")), pools)


@query("SELECT pool, device, used * 100 > capacity * 60 AS \"over\", row_number() OVER (PARTITION BY pool, used * 100 > capacity * 60 ORDER BY CASE WHEN used * 100 > capacity * 60 THEN -(used / capacity) ELSE used / capacity END, device) AS rank FROM devices")
def rebalance_ranks(spark, d):
    return p.rebalance_ranks(model.devices(spark, d), 60)


@query("""
, g AS (SELECT pool, device, capacity, used, used // 700 AS n FROM devices),
v AS (SELECT *, used * 100 > capacity * 60 AS over_, CASE WHEN n > 0 THEN used // n END AS mean, used - capacity * 60 // 100 AS excess FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY pool, over_ ORDER BY CASE WHEN over_ THEN -(used / capacity) ELSE used / capacity END, device) AS k FROM v WHERE NOT over_ OR (mean > 0 AND excess > 0)),
m AS (SELECT s.pool, s.device AS src, t.device AS dst, s.mean, least((s.excess + s.mean - 1) // s.mean, (t.capacity - t.used) // s.mean, s.n) AS moved FROM r s JOIN r t ON s.pool = t.pool AND s.k = t.k AND s.over_ AND NOT t.over_)
SELECT pool, src AS "from", dst AS "to", array_to_string(list_transform(range(moved), lambda i: src * 100 + i), ',') AS chunks, moved * mean AS bytes FROM m WHERE moved > 0
""")
def rebalance_plan(spark, d):
    n = F.expr("used div 700")
    chunks = F.transform(F.slice(F.sequence(F.lit(0).cast("long"), n), F.lit(1), n.cast("int")), lambda i: F.col("device") * 100 + i)
    moves = p.rebalance_plan(model.devices(spark, d).withColumn("chunks", chunks), 60)
    return moves.withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ","))


@query("SELECT pool AS device, count(*) AS chunks, array_to_string(list(device ORDER BY device), ',') AS targets FROM devices WHERE online GROUP BY 1")
def evacuation_plan(spark, d):
    targets = F.array_join(F.transform(F.sort_array(F.collect_list("device")), lambda x: x.cast("string")), ",")
    return model.devices(spark, d).filter("online").groupBy(F.col("pool").alias("device")).agg(F.count("*").alias("chunks"), targets.alias("targets"))


@query("SELECT id, category FROM history ORDER BY id DESC LIMIT 50")
def recent_events(spark, d):
    return model.history(spark, d).orderBy(F.desc("id")).limit(50).select("id", "category")


@query("SELECT id, source FROM history WHERE category = 'error' ORDER BY id DESC LIMIT 100")
def recent_repairs(spark, d):
    limit = 0  # zero asks for the default of 100; more than 1000 is not given
    return model.history(spark, d).filter("category = 'error'").orderBy(F.desc("id")).limit(min(limit or 100, 1000)).select("id", "source")


@query("SELECT shard, seq, key, row_number() OVER (ORDER BY key, at_ms, seq, shard) AS new_seq FROM deltas WHERE shard IN (0, 1)")
def merge_order(spark, d):
    deltas = model.deltas(spark, d)
    return p.merge_copy(deltas.filter("shard = 0"), deltas.filter("shard = 1")).select("shard", "seq", "key", "new_seq")


@query("SELECT key, count(*) AS n, max(new_seq) AS last_seq FROM (SELECT key, row_number() OVER (ORDER BY key, at_ms, seq, shard) AS new_seq FROM deltas WHERE shard IN (2, 3)) GROUP BY 1")
def merge_copy(spark, d):
    deltas = model.deltas(spark, d)
    return p.merge_copy(deltas.filter("shard = 2"), deltas.filter("shard = 3")).groupBy("key").agg(F.count("*").alias("n"), F.max("new_seq").alias("last_seq"))


@query("""
, n AS (SELECT source % 9 AS volume, id AS need, amount AS bytes FROM history), f AS (SELECT source % 9 AS volume, amount + 3 AS bytes, min(id) AS extent FROM history GROUP BY 1, 2)
SELECT n.volume, n.need, arg_min(f.extent, f.bytes) AS extent FROM n LEFT JOIN f ON n.volume = f.volume AND f.bytes >= n.bytes GROUP BY 1, 2
""")
def best_fit_extent(spark, d):
    h = model.history(spark, d).withColumn("volume", F.col("source") % 9)
    return p.best_fit(h.select("volume", F.col("id").alias("need"), F.col("amount").alias("bytes")), h.select("volume", F.col("id").alias("extent"), (F.col("amount") + 3).alias("bytes")))


@query("SELECT source AS peer, coalesce(arg_min(category, id) FILTER (amount % 3 = 0 AND amount > 10), 'tcp-tls') AS transport, count(*) FILTER (NOT amount > 10) AS reprobe FROM history GROUP BY 1")
def transport_select(spark, d):
    rows = model.history(spark, d).select(F.col("source").alias("peer"), F.col("category").alias("transport"), F.col("id").alias("rank"), (F.col("amount") % 3 == 0).alias("available"), (F.col("amount") > 10).alias("healthy"))
    return p.transport_select(rows)


@query("SELECT project AS nodes, greatest(least(project * 3, 64), 3)::BIGINT AS shards, greatest(project // 5, 1)::BIGINT AS splits FROM project")
def initial_shards(spark, d):
    k = F.col("project")
    return model.projects(spark, d).select(k.alias("nodes"), p.initial_shards(k).alias("shards"), p.max_concurrent_splits(k).alias("splits"))


@query("SELECT project AS nodes, greatest(project // 5, 1)::BIGINT AS splits FROM project")
def max_concurrent_splits(spark, d):
    return model.projects(spark, d).select(F.col("project").alias("nodes"), p.max_concurrent_splits(F.col("project")).alias("splits"))


_DIGITS = """
digits AS (SELECT i, 0 AS k, i AS rest, '' AS hex FROM range(12) r(i) UNION ALL SELECT i, k + 1, rest * 16 % 12, hex || substr('0123456789abcdef', (rest * 16 // 12)::INT + 1, 1) FROM digits WHERE k < 64),
points AS (SELECT i, hex FROM digits WHERE k = 64 UNION ALL SELECT 12, repeat('f', 64))
"""


@query(f", {_DIGITS} SELECT a.i AS shard, a.hex AS range_start, b.hex AS range_end, a.i % 5 AS leader FROM points a JOIN points b ON b.i = a.i + 1")
def shard_ranges(spark, d):
    return p.shard_ranges(spark, 12, 5)


@query(f"""
, {_DIGITS},
ends AS (SELECT a.i, a.hex AS lo, b.hex AS hi FROM points a JOIN points b ON b.i = a.i + 1),
sums AS (SELECT i, lo, hi, 64 AS k, 0 AS carry, ''::VARCHAR AS hex FROM ends UNION ALL
 SELECT i, lo, hi, k - 1, s // 16, substr('0123456789abcdef', (s % 16)::INT + 1, 1) || hex FROM (SELECT *, strpos('0123456789abcdef', substr(lo, k, 1)) + strpos('0123456789abcdef', substr(hi, k, 1)) - 2 + carry AS s FROM sums WHERE k > 0)),
halves AS (SELECT i, lo, hi, hex AS sum, 0 AS k, carry AS rest, ''::VARCHAR AS mid FROM sums WHERE k = 0 UNION ALL
 SELECT i, lo, hi, sum, k + 1, v % 2, mid || substr('0123456789abcdef', (v // 2)::INT + 1, 1) FROM (SELECT *, rest * 16 + strpos('0123456789abcdef', substr(sum, k + 1, 1)) - 1 AS v FROM halves WHERE k < 64))
SELECT i AS shard, lo AS range_start, hi AS range_end, i % 5 AS leader, CASE WHEN lo < mid AND mid < hi THEN mid END AS mid FROM halves WHERE k = 64
""")
def midpoint(spark, d):
    return p.shard_ranges(spark, 12, 5).withColumn("mid", p.midpoint("range_start", "range_end"))


@query("SELECT shard, CASE WHEN count(*) >= 2600 THEN 'count' WHEN sum(payload_size + 128) >= 400000 THEN 'bytes' END AS reason FROM deltas GROUP BY 1")
def check_split(spark, d):
    from deltaloom.operators import log

    return log.shard_sizes(model.deltas(spark, d)).select("shard", p.check_split(F.col("delta_count"), F.col("byte_size"), 2600, 400_000).alias("reason"))


@query("SELECT shard, CASE WHEN count(*) >= 2500 THEN min(seq) + (max(seq) - min(seq)) // 2 END AS split_at FROM deltas GROUP BY 1")
def split_plan(spark, d):
    shards = model.deltas(spark, d).groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("delta_count"))
    return p.split_plan(shards, 1250)


@query("SELECT CASE WHEN shard = 1 AND key >= 60 THEN 9 ELSE shard END AS shard, count(*) AS delta_count, sum(payload_size + 128)::BIGINT AS byte_size FROM deltas GROUP BY 1")
def split_apply(spark, d):
    from deltaloom.operators import log

    return log.shard_sizes(p.split_apply(model.deltas(spark, d), 1, 9, 60))


@query("SELECT seq, CASE WHEN shard = 1 AND NOT (key >= 0 AND key < 60) THEN 9 ELSE shard END AS shard, CASE WHEN shard <> 1 OR (key >= 0 AND key < 60) THEN 'direct' ELSE 'parked' END AS route FROM deltas")
def split_buffer(spark, d):
    return p.split_buffer(model.deltas(spark, d), 1, 0, 60, 9).select("seq", "shard", "route")


@query(", s AS (SELECT project AS shard, project * 10 AS lo, project * 10 + CASE WHEN project % 4 = 0 THEN 9 ELSE 10 END AS hi, project % 7 = 0 AS busy FROM project) SELECT a.shard AS a, b.shard AS b FROM s a JOIN s b ON a.hi = b.lo WHERE NOT a.busy AND NOT b.busy")
def merge_plan(spark, d):
    k = F.col("project")
    return p.merge_plan(model.projects(spark, d).select(k.alias("shard"), (k * 10).alias("range_start"), (k * 10 + F.when(k % 4 == 0, 9).otherwise(10)).alias("range_end"), (k % 7 == 0).alias("busy")))


@query("SELECT project AS shards, org AS nodes, CASE WHEN org = 0 THEN false ELSE (project - 1) / org >= 1.5 END AS allowed, CASE WHEN org > 0 AND project / org < 1.5 THEN least(CAST(ceil(1.5 * org) AS BIGINT), 64) ELSE project END AS target FROM project")
def merge_ratio(spark, d):
    s, n, f = F.col("project"), F.col("org"), F.lit(1.5)
    return model.projects(spark, d).select(s.alias("shards"), n.alias("nodes"), p.merge_allowed(s, n, f).alias("allowed"), p.ratio_floor_target(s, n, f).alias("target"))


@query()
def ratio_floor_split(spark, d):
    """A topology of 5 shards on 8 nodes, split at the widest until the ratio holds."""
    shards = p.shard_ranges(spark, 5, 8)
    return p.ratio_floor_split(spark, shards, 8, 1.5)


@query("SELECT project AS shards, org AS nodes, CASE WHEN org > 0 AND project / org < 1.5 THEN least(CAST(ceil(1.5 * org) AS BIGINT), 64) ELSE project END AS target FROM project")
def ratio_floor_target(spark, d):
    s, n = F.col("project"), F.col("org")
    return model.projects(spark, d).select(s.alias("shards"), n.alias("nodes"), p.ratio_floor_target(s, n, F.lit(1.5)).alias("target"))
