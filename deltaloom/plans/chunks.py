"""Queries over chunks, objects and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltaloom.operators import chunks as c
from deltaloom.sources import model

from .registry import query


@query("SELECT tenant, chunk_id, count(*) AS refcount, max(size) AS size FROM chunk_refs GROUP BY 1, 2")
def chunk_state_scan(spark, d):
    return c.chunk_state(model.chunk_refs(spark, d))


@query("SELECT tenant, chunk_id, count(*) AS refcount, max(size) AS size FROM chunk_refs WHERE tenant = 'src1' AND chunk_id = (SELECT min(chunk_id) FROM chunk_refs WHERE tenant = 'src1') GROUP BY 1, 2")
def chunk_state_get(spark, d):
    state = c.chunk_state(model.chunk_refs(spark, d).filter("tenant = 'src1'"))
    return state.join(F.broadcast(state.agg(F.min("chunk_id").alias("chunk_id"))), "chunk_id").select("tenant", "chunk_id", "refcount", "size")


@query("""
, o AS (SELECT conv_id AS id, hex(encode(string_agg(text, '' ORDER BY turn))) AS h, strlen(string_agg(text, '' ORDER BY turn))::BIGINT AS size FROM conversations GROUP BY 1)
SELECT id, substr(h, 2 * 100 + 1, 2 * 50) AS data, size <= 150 AS eof, size FROM o
""")
def object_read(spark, d):
    parts = model.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.col("text").alias("body"))
    return c.object_read(parts, 100, 50).withColumn("data", F.hex("data"))


_SPECS = ("bytes=0-99", "bytes=500-", "bytes=-100", "bytes=9-3", "bytes=0-1,5-6", "items=1-2", "bytes=-", "bytes=-0", "bytes=999999999-", "bytes=x-3", " bytes=2-9 ", "bytes=99999999999999999999-", "bytes=0-99999999999999999999")


@query(f"""
, s AS (SELECT ref, size, spec, trim(spec) AS spec_ FROM chunk_refs, (VALUES {", ".join(f"('{x}')" for x in _SPECS)}) v(spec)),
p AS (SELECT *, regexp_extract(spec_, '^bytes=(.*)$', 1) AS body FROM s),
q AS (SELECT *, regexp_extract(body, '^([0-9]*)-([0-9]*)$', 1) AS a, regexp_extract(body, '^([0-9]*)-([0-9]*)$', 2) AS b FROM p),
r AS (SELECT *, try_cast(nullif(a, '') AS BIGINT) AS lo, try_cast(nullif(b, '') AS BIGINT) AS hi FROM q),
t AS (SELECT *, CASE WHEN NOT starts_with(spec_, 'bytes=') THEN 'malformed' WHEN contains(body, ',') THEN 'unsatisfiable' WHEN NOT regexp_full_match(body, '[0-9]*-[0-9]*') OR (a = '' AND b = '') OR (a <> '' AND lo IS NULL) OR (b <> '' AND hi IS NULL) THEN 'malformed'
  WHEN (a <> '' AND lo >= size) OR (a = '' AND (hi = 0 OR size = 0)) OR (a <> '' AND b <> '' AND hi < lo) THEN 'unsatisfiable' ELSE 'ok' END AS state FROM r)
SELECT ref, spec, state, CASE WHEN state = 'ok' THEN CASE WHEN a = '' THEN greatest(size - hi, 0) ELSE lo END END AS "first", CASE WHEN state = 'ok' THEN CASE WHEN a = '' OR b = '' THEN size - 1 ELSE least(hi, size - 1) END END AS "last" FROM t
""")
def http_range(spark, d):
    rows = model.chunk_refs(spark, d).withColumn("spec", F.explode(F.array(*map(F.lit, _SPECS))))
    return rows.select("ref", "spec", *(x.alias(k) for k, x in c.http_range(F.col("spec"), F.col("size")).items()))


@query("""
, o AS (SELECT doc_id AS id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents), p AS (SELECT id, h, unnest(generate_series(0, greatest((n + 999) // 1000, 1) - 1)) AS pos FROM o)
SELECT id, pos, (length(substr(h, pos * 2000 + 1, 2000)) // 2)::BIGINT AS size, sha256(from_hex(substr(h, pos * 2000 + 1, 2000))) AS chunk_id FROM p
""")
def object_write_split(spark, d):
    objects = model.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    return c.object_write_split(objects, 1000)


@query("SELECT id, size FROM names WHERE ns LIKE '%.com'")
def list_namespace(spark, d):
    return model.names(spark, d).filter(F.col("ns").endswith(".com")).select("id", "size")


@query("SELECT ns, name, id FROM names WHERE starts_with(name, 'en/')")
def list_names_prefix(spark, d):
    return model.names(spark, d).filter(F.col("name").startswith("en/")).orderBy("name").select("ns", "name", "id")


_KEYS = """
, every AS (SELECT name AS key, size FROM names UNION ALL SELECT ref::VARCHAR, size FROM chunk_refs WHERE ref NOT IN (SELECT id FROM names)),
k AS (SELECT key, size FROM every WHERE starts_with(key, '3') ORDER BY key, size LIMIT 31 OFFSET 10), n AS (SELECT count(*) AS found FROM k)
SELECT key, size, found > 30 AS truncated, CASE WHEN found > 30 THEN 40::BIGINT END AS next FROM (SELECT * FROM k ORDER BY key, size LIMIT 30), n
"""


@query(_KEYS)
def list_objects_v2(spark, d):
    unnamed = model.chunk_refs(spark, d).select(F.col("ref").alias("id"), "size")
    return c.list_objects(model.names(spark, d), unnamed, "3", 10, 30)


@query("SELECT name AS key FROM names UNION ALL SELECT ref::VARCHAR FROM chunk_refs WHERE ref NOT IN (SELECT id FROM names)")
def list_union(spark, d):
    n = model.names(spark, d)
    loose = model.chunk_refs(spark, d).withColumnRenamed("ref", "id").join(n.select("id"), "id", "left_anti").select(F.col("id").cast("string").alias("key"))
    return n.select(F.col("name").alias("key")).unionByName(loose)


@query("SELECT key, arg_max(amount, id) AS value, key NOT IN (SELECT source FROM history WHERE id < 300) AS is_new FROM (SELECT source AS key, amount, id FROM history WHERE id >= 300) GROUP BY 1")
def small_object_kv(spark, d):
    h = model.history(spark, d)
    puts = h.filter("id >= 300").select(F.col("source").alias("key"), F.col("amount").alias("value"), F.col("id").alias("at"))
    return c.small_object_put(puts, h.filter("id < 300").select(F.col("source").alias("key")).distinct())


_OPS = ", o AS (SELECT source AS key, id AS at, CASE WHEN category = 'error' THEN 'delete' WHEN category = 'view' THEN 'get' WHEN category = 'click' THEN 'contains' ELSE 'put' END AS op, amount AS value FROM history)"


def _ops(spark, d):
    op = F.when(F.col("category") == "error", "delete").when(F.col("category") == "view", "get").when(F.col("category") == "click", "contains").otherwise("put")
    return model.history(spark, d).select(F.col("source").alias("key"), F.col("id").alias("at"), op.alias("op"), F.col("amount").alias("value"))


@query(_OPS + """,
s AS (SELECT *, last_value(CASE op WHEN 'put' THEN 1 WHEN 'delete' THEN 0 END IGNORE NULLS) OVER w AS held, last_value(CASE op WHEN 'put' THEN value WHEN 'delete' THEN -1 END IGNORE NULLS) OVER w AS was FROM o
 WINDOW w AS (PARTITION BY key ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, at, op, CASE op WHEN 'put' THEN coalesce(held, 0) = 0 ELSE coalesce(held, 0) = 1 END AS flag, CASE WHEN op = 'get' AND held = 1 THEN was END AS value FROM s
""")
def small_object_log(spark, d):
    return c.small_object_log(_ops(spark, d))


@query(_OPS + ", l AS (SELECT key, arg_max(op, at) AS op, arg_max(value, at) AS value FROM o WHERE op IN ('put', 'delete') GROUP BY 1) SELECT count(*) AS keys, coalesce(sum(strlen(value::VARCHAR)), 0)::BIGINT AS bytes FROM l WHERE op = 'put'")
def small_object_len(spark, d):
    return c.small_object_len(_ops(spark, d))


@query("SELECT id, created FROM (SELECT id, at_ms // 1000 AS created FROM history) WHERE created + 7 * 86400 < 1706659200")
def backup_retention(spark, d):
    backups = model.history(spark, d).select("id", F.expr("at_ms div 1000").alias("created"))
    return c.backup_retention(backups, 1_706_659_200, 7)


@query("SELECT ref, chunk_id FROM chunk_refs")
def chunk_id_sha256(spark, d):
    return model.chunk_refs(spark, d).select("ref", "chunk_id")


@query("""
, store AS (SELECT chunk_id, count(*) AS refcount FROM chunk_refs WHERE ref % 4 = 0 GROUP BY 1)
SELECT r.chunk_id, min(r.ref) AS first_ref, max(r.size) AS size, count(*) + coalesce(any_value(s.refcount), 0) AS refcount, any_value(s.refcount) IS NULL AS is_new FROM chunk_refs r LEFT JOIN store s ON r.chunk_id = s.chunk_id WHERE r.ref % 4 <> 0 GROUP BY 1
""")
def dedup_write(spark, d):
    refs = model.chunk_refs(spark, d)
    store = refs.filter("ref % 4 = 0").groupBy("chunk_id").agg(F.count("*").alias("refcount"))
    return c.dedup_write(refs.filter("ref % 4 <> 0"), store)


@query("SELECT tenant, sum(size * 3)::BIGINT AS replicated, sum(6 * ((size + 3) // 4))::BIGINT AS coded FROM chunk_refs GROUP BY 1")
def stored_bytes(spark, d):
    size = F.col("size")
    return model.chunk_refs(spark, d).groupBy("tenant").agg(F.sum(c.stored_bytes(size, 3)).alias("replicated"), F.sum(c.stored_bytes(size)).cast("long").alias("coded"))


@query("SELECT c.tenant AS pool, count(*) AS chunks, sum(c.size)::BIGINT AS freed FROM chunk_refs c JOIN chunk_meta m ON c.ref = m.ref WHERE m.tombstoned AND c.ref % 5 <> 0 GROUP BY 1")
def chunk_gc(spark, d):
    state = model.chunk_refs(spark, d).join(model.chunk_meta(spark, d), "ref")
    state = state.select("tenant", "size", F.when(F.col("tombstoned"), 0).otherwise(1).alias("refcount"), F.when(F.col("ref") % 5 == 0, F.array(F.lit("legal"))).otherwise(F.array().cast("array<string>")).alias("holds"))
    return c.chunk_gc(state).groupBy(F.col("tenant").alias("pool")).agg(F.count("*").alias("chunks"), F.sum("size").alias("freed"))


@query("SELECT source, array_to_string(list_sort(list_filter(list_distinct(list_concat(['legal'], list(DISTINCT category))), lambda x: x <> 'view')), ',') AS holds FROM history GROUP BY 1")
def retention_holds(spark, d):
    held = model.history(spark, d).groupBy("source").agg(F.collect_set("category").alias("added"))
    return held.select("source", F.array_join(c.apply_holds(F.array(F.lit("legal")), F.col("added"), F.array(F.lit("view"))), ",").alias("holds"))


@query("SELECT CASE WHEN category = 'error' THEN 'bypass' WHEN amount < 10 THEN 'l1' WHEN amount < 40 THEN 'l2' ELSE 'miss' END AS outcome, count(*) AS n FROM history GROUP BY 1")
def cache_outcomes(spark, d):
    outcome = c.cache_outcome(F.col("category") == "error", F.col("amount") < 10, F.col("amount") < 40)
    return model.history(spark, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT tenant AS dataset, ref FROM chunk_refs WHERE tenant NOT IN ('src1', 'src2')")
def staging_release(spark, d):
    staged = model.chunk_refs(spark, d).select(F.col("tenant").alias("dataset"), "ref")
    released = spark.createDataFrame([("src1",), ("src2",)], "dataset string")
    return staged.join(released, "dataset", "left_anti")


@query("SELECT id FROM history WHERE 1706659200000 - at_ms <= 864000000")
def metadata_ttl_cache(spark, d):
    return model.history(spark, d).filter(F.lit(1_706_659_200_000) - F.col("at_ms") <= 864_000_000).select("id")


_FOLD = """
, x AS (SELECT seq, key, op, payload_size % 3 AS value, count(*) FILTER (op = 'Delete') OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM deltas),
y AS (SELECT *, min(seq) FILTER (op = 'Create') OVER (PARTITION BY key, life) AS made FROM x)
"""


@query(_FOLD + """
, z AS (SELECT * FROM y WHERE (op = 'Update' AND seq > made) OR (op = 'Create' AND seq = made)),
w AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY key, life ORDER BY seq) <> value, true) AS fresh FROM z),
l AS (SELECT key, count(*) FILTER (op = 'Delete') AS last_life FROM deltas GROUP BY 1)
SELECT w.key, arg_max(value, seq) AS value, count(*) FILTER (fresh) AS version, max(seq) FILTER (fresh) AS seq FROM w JOIN l ON w.key = l.key AND w.life = l.last_life GROUP BY 1
""")
def hydrate_compositions(spark, d):
    return c.hydrate(model.deltas(spark, d).select("seq", "key", "op", (F.col("payload_size") % 3).alias("value")))


@query(_FOLD + "SELECT seq, key, op, CASE WHEN op = 'Create' THEN 'Applied' WHEN coalesce(seq > made, false) THEN 'Applied' ELSE 'PermanentSkip' END AS outcome FROM y")
def hydrate_outcomes(spark, d):
    return c.hydrate_outcomes(model.deltas(spark, d))


_POLL = """
, d AS (SELECT seq, shard, CASE WHEN payload_size % 13 = 0 THEN 'NamespaceCreate' ELSE op END AS op, CASE WHEN payload_size % 13 <> 0 THEN key END AS key, key % 6 AS ns, CASE WHEN key % 2 = 0 THEN 'n' || (key % 10) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n, seq AS old FROM deltas)),
e AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n FROM d),
g AS (SELECT shard, n AS seq, op, key, ns, name FROM e),
sp AS (SELECT shard, ns, min(seq) AS reg FROM g WHERE op = 'NamespaceCreate' GROUP BY 1, 2),
h AS (SELECT g.*, reg, count(*) FILTER (op = 'Delete') OVER (PARTITION BY g.shard, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM g LEFT JOIN sp ON g.shard = sp.shard AND g.ns = sp.ns),
i AS (SELECT *, min(seq) FILTER (op = 'Create' AND reg < seq) OVER (PARTITION BY shard, key, life) AS made FROM h),
j AS (SELECT *, CASE WHEN op = 'Create' AND NOT coalesce(made < seq, false) AND NOT coalesce(reg < seq, false) THEN 'namespace_not_registered' WHEN op = 'Update' AND NOT coalesce(made < seq, false) THEN 'update_before_create' END AS why FROM i),
cur(shard, position) AS (VALUES (0, 0), (1, 40), (2, 0), (3, 0)),
vis AS (SELECT j.*, position FROM j JOIN cur USING (shard) WHERE seq > position AND (shard <> 3 OR seq > 5)),
stp AS (SELECT shard, seq AS stop FROM (SELECT shard, seq, row_number() OVER (PARTITION BY shard ORDER BY seq) AS k FROM vis WHERE why IS NOT NULL) WHERE k = 4),
o AS (SELECT shard, seq, op, key, ns, name, CASE WHEN shard = 3 THEN 'Halted' WHEN seq > stop THEN 'Pending' WHEN seq = stop THEN 'TransientSkip' WHEN why IS NOT NULL THEN 'PermanentSkip' ELSE 'Applied' END AS outcome, why FROM vis LEFT JOIN stp USING (shard))
"""


def _poll(spark, d):
    """Deltas numbered without gaps per shard; shard 3 lost its first ones to compaction; 8 polls of 3 tries each."""
    x = model.deltas(spark, d)
    number = F.row_number().over(Window.partitionBy("shard").orderBy("seq"))
    space = F.col("payload_size") % 13 == 0
    every = x.select(
        "shard", number.cast("long").alias("n"), F.when(space, "NamespaceCreate").otherwise(F.col("op")).alias("op"), F.when(~space, F.col("key")).alias("key"),
        (F.col("key") % 6).alias("ns"), F.when(F.col("key") % 2 == 0, F.concat(F.lit("n"), F.col("key") % 10)).alias("name"),
    ).withColumnRenamed("n", "seq")
    cursors = spark.createDataFrame([(0, 0), (1, 40), (2, 0), (3, 0)], "shard long, position long")
    deltas = every.filter("shard <> 3 OR seq > 5")
    return deltas, cursors, c.hydrate_poll(deltas, cursors, 8, 3)


@query(_POLL + "SELECT shard, seq, op, key, outcome, CASE outcome WHEN 'TransientSkip' THEN why WHEN 'PermanentSkip' THEN 'exhausted_retries' END AS reason, CASE outcome WHEN 'TransientSkip' THEN 2::BIGINT END AS tries FROM o WHERE shard <> 3 UNION ALL SELECT shard, seq, op, key, outcome, NULL, NULL FROM o WHERE shard = 3")
def hydrate_poll(spark, d):
    return _poll(spark, d)[2]


@query(_POLL + "SELECT cur.shard::BIGINT AS shard, coalesce(max(seq) FILTER (outcome IN ('Applied', 'PermanentSkip')), any_value(position))::BIGINT AS position, max(seq) FILTER (outcome = 'TransientSkip') AS stuck_at, max(CASE outcome WHEN 'TransientSkip' THEN 2::BIGINT END) AS tries, coalesce(bool_or(outcome = 'Halted'), false) AS halted FROM cur LEFT JOIN o ON cur.shard = o.shard GROUP BY 1")
def hydrate_cursor(spark, d):
    _, cursors, outcomes = _poll(spark, d)
    return c.hydrate_cursor(outcomes, cursors)


@query(_POLL + """
, b AS (SELECT shard, ns, name, max(seq) AS seq, arg_max(key, seq) AS key FROM o WHERE outcome = 'Applied' AND op = 'Create' AND name IS NOT NULL GROUP BY 1, 2, 3)
SELECT shard, ns, name, key FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.shard = b.shard AND o.key = b.key AND o.op = 'Delete' AND o.outcome = 'Applied' AND o.seq > b.seq)
""")
def names_index(spark, d):
    deltas, _, outcomes = _poll(spark, d)
    return c.names_index(outcomes, deltas)


@query("""
, c AS (SELECT key AS chunk, shard AS tenant, seq AS at, CASE op WHEN 'Delete' THEN 'decrement' WHEN 'Create' THEN 'create' ELSE 'increment' END AS command, payload_size AS len FROM deltas),
m AS (SELECT tenant, chunk, min(at) AS made, arg_min(len, at) AS len FROM c WHERE command = 'create' GROUP BY 1, 2),
s AS (SELECT c.tenant, c.chunk, at, CASE command WHEN 'decrement' THEN -1 ELSE 1 END AS step FROM c JOIN m ON c.tenant = m.tenant AND c.chunk = m.chunk WHERE at = made OR (at > made AND command <> 'create')),
r AS (SELECT *, sum(step) OVER (PARTITION BY tenant, chunk ORDER BY at ROWS UNBOUNDED PRECEDING) AS raw FROM s),
w AS (SELECT *, raw - least(min(raw) OVER (PARTITION BY tenant, chunk ORDER BY at ROWS UNBOUNDED PRECEDING), 0) AS n FROM r)
SELECT w.tenant, w.chunk, arg_max(n, at)::BIGINT AS refcount, arg_max(n, at) = 0 AS tombstoned, any_value(made) AS created_at, any_value(made % 7) AS placement, any_value(len) AS original_len FROM w JOIN m ON w.tenant = m.tenant AND w.chunk = m.chunk GROUP BY 1, 2
""")
def chunk_state_machine(spark, d):
    command = F.when(F.col("op") == "Delete", "decrement").when(F.col("op") == "Create", "create").otherwise("increment")
    rows = model.deltas(spark, d).select(F.col("shard").alias("tenant"), F.col("key").alias("chunk"), F.col("seq").alias("at"), command.alias("command"), (F.col("seq") % 7).alias("placement"), F.col("payload_size").alias("original_len"))
    return c.chunk_states(rows)
