"""Queries of scalar functions and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from deltaloom.functions import coding, scalar
from deltaloom.sources import model

from .registry import query

_KEY = b"chunk id key"
_IPAD, _OPAD = (bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


def _docs(spark, d):
    return model.table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT doc_id AS ref, sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode(coalesce(text, ''))))) AS chunk_id FROM documents")
def chunk_id_hmac(spark, d):
    return _docs(spark, d).select("ref", scalar.hmac_sha256(_KEY, F.col("text")).alias("chunk_id"))


@query("SELECT ref, CASE WHEN size % 5 = 0 THEN 0 ELSE length(bin(size)) END::BIGINT AS bucket FROM chunk_refs")
def log2_bucket(spark, d):
    n = F.when(F.col("size") % 5 == 0, 0).otherwise(F.col("size"))
    return model.chunk_refs(spark, d).select("ref", scalar.log2_bucket(n).alias("bucket"))


@query("SELECT id, CASE WHEN 64 + 8 * amount <= 128 THEN 128 WHEN 64 + 8 * amount <= 256 THEN 256 WHEN 64 + 8 * amount <= 512 THEN 512 ELSE 1024 END AS bucket FROM history")
def size_bucket(spark, d):
    return model.history(spark, d).select("id", scalar.size_bucket(F.col("amount")).alias("bucket"))


@query("SELECT id, CASE WHEN amount * 5 <= 50 THEN 50 WHEN amount * 5 <= 100 THEN 100 WHEN amount * 5 <= 250 THEN 250 ELSE 500 END AS bucket FROM history")
def retry_bucket(spark, d):
    return model.history(spark, d).select("id", scalar.retry_bucket(F.col("amount") * 5).alias("bucket"))


_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f", u AS (SELECT DISTINCT ns, sha1(from_hex('{scalar.DNS_NAMESPACE}') || encode(ns)) AS h FROM names) SELECT ns, {_UUID5} AS id FROM u")
def namespace_from_bucket(spark, d):
    return model.names(spark, d).select("ns").distinct().select("ns", scalar.uuid5(F.lit(scalar.DNS_NAMESPACE), F.col("ns")).alias("id"))


@query(f", u AS (SELECT id, sha1(from_hex(md5(ns)) || encode(id::VARCHAR)) AS h FROM names), v AS (SELECT id, replace({_UUID5}, '-', '') AS k FROM u) SELECT id, k || k AS hash_key FROM v")
def composition_hash_key(spark, d):
    k = F.replace(scalar.uuid5(F.md5("ns"), F.col("id").cast("string")), F.lit("-"), F.lit(""))
    return model.names(spark, d).select("id", F.concat(k, k).alias("hash_key"))


@query("SELECT project AS data, (project + 2) / project AS overhead FROM project WHERE project > 0")
def ec_overhead(spark, d):
    k = F.col("project")
    return model.projects(spark, d).filter("project > 0").select(k.alias("data"), ((k + 2) / k).alias("overhead"))


@query("SELECT project AS nodes, CASE WHEN project <= 1 THEN 1 WHEN project = 2 THEN 2 WHEN project <= 5 THEN 3 ELSE 6 END AS copies, CASE WHEN project <= 1 THEN 1 WHEN project = 2 THEN 2 WHEN project <= 5 THEN 2 ELSE 4 END AS min_acks, CASE WHEN project <= 5 THEN 'replication' ELSE 'ec-4-2' END AS strategy FROM project")
def durability_defaults(spark, d):
    return model.projects(spark, d).select(F.col("project").alias("nodes"), *(c.alias(n) for n, c in scalar.durability_defaults(F.col("project")).items()))


_CRC_TABLE = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]
_CHARS = "SELECT doc_id AS ref, string_split(hex(encode(coalesce(text, ''))), '') AS c, strlen(coalesce(text, '')) AS n FROM documents"
_BYTE = "((strpos('0123456789ABCDEF', c[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', c[2 * i + 2]) - 1)::BIGINT"


@query(f"""
, x AS ({_CHARS}), b AS (SELECT ref, list_transform(range(n), lambda i: {_BYTE}) AS b FROM x), t AS (SELECT {_CRC_TABLE}::BIGINT[] AS t)
SELECT ref, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda h, v: xor(h >> 8, t[(xor(h, v) & 255) + 1])), 4294967295) AS crc FROM b, t
""")
def crc32(spark, d):
    return _docs(spark, d).select("ref", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("SELECT device, CASE WHEN capacity = 0 THEN 0.0::DOUBLE ELSE used / capacity END AS ratio FROM devices")
def usage_ratio(spark, d):
    return model.devices(spark, d).select("device", scalar.usage_ratio(F.col("used"), F.col("capacity")).alias("ratio"))


@query("SELECT id, CASE WHEN source % 5 = id % 5 THEN 'equal' WHEN source % 5 > id % 5 THEN 'reader_newer' ELSE 'reader_older' END AS verdict FROM history")
def version_check(spark, d):
    return model.history(spark, d).select("id", scalar.version_check(F.col("source") % 5, F.col("id") % 5).alias("verdict"))


@query("SELECT id, strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso, lower(hex(id)) AS hex_id FROM history")
def iso_epoch(spark, d):
    seconds = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, at_ms div 1000)")
    return model.history(spark, d).select("id", F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.lower(F.hex("id")).alias("hex_id"))


@query("SELECT ref, ref % 3 = 0 AND size > 0 AND size <= 1000 AS inlined FROM chunk_refs")
def inline_flag(spark, d):
    return model.chunk_refs(spark, d).select("ref", scalar.inline_flag(F.col("ref") % 3, F.col("size"), 1000).alias("inlined"))


@query("""
, s AS (SELECT ref, chunk_id, lpad(lower(hex(ref)), 16, '0') AS h FROM chunk_refs),
b AS (SELECT *, list_transform(range(8), lambda i: xor(('0x' || substr(chunk_id, 49 + 2 * i::INT, 2))::INT, ('0x' || substr(h, 15 - 2 * i::INT, 2))::INT)) AS tail FROM s)
SELECT ref, substr(chunk_id, 1, 48) || array_to_string(list_transform(tail, lambda x: lpad(lower(hex(x)), 2, '0')), '') AS mixed FROM b
""")
def inline_key(spark, d):
    return model.chunk_refs(spark, d).select("ref", scalar.inline_key(F.col("chunk_id"), F.col("ref")).alias("mixed"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS dump FROM events")
def json_details(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    dump = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return model.table(spark, d, "events").select(F.col("event_id").alias("id"), k.alias("k"), dump.alias("dump"))


def _coded(spark, d):
    docs = _docs(spark, d).select("ref", F.col("text").cast("binary").alias("payload"))
    return docs.withColumn("fragments", coding.ec_encode(4, 2)("payload"))


_PARITY = [[int(x) for x in row] for row in coding.generator(4, 2)[4:]]


@query(f"""
, m AS (SELECT parity, part, list_transform(range(256), lambda v: list_reduce(list_transform(range(8), lambda k: CASE WHEN (v >> k::INT) & 1 = 1 THEN powers[k + 1] ELSE 0 END), lambda x, y: xor(x, y))) AS times
 FROM (VALUES {", ".join(f"({i}, {j}, {[int(coding.multiply(c, 1 << k)) for k in range(8)]})" for i, row in enumerate(_PARITY) for j, c in enumerate(row))}) v(parity, part, powers)),
x AS (SELECT doc_id AS ref, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT ref, (n + 3) // 4 AS size, rpad(h, (2 * ((n + 3) // 4) * 4)::INT, '0') AS h FROM x),
f AS (SELECT ref, part, size, substr(h, (2 * part * size + 1)::INT, (2 * size)::INT) AS h FROM p, range(4) r(part)),
s AS (SELECT ref, part, string_split(h, '') AS c, size FROM f),
b AS (SELECT ref, part, unnest(range(size)) AS at_, unnest(list_transform(range(size), lambda i: {_BYTE})) AS v FROM s),
y AS (SELECT ref, 4 + parity AS part, at_, bit_xor(times[v + 1]) AS v FROM b JOIN m USING (part) GROUP BY 1, 2, 3),
q AS (SELECT ref, part, string_agg(lpad(hex(v), 2, '0'), '' ORDER BY at_) AS h FROM y GROUP BY 1, 2)
SELECT p.ref, k AS fragment, p.size, sha256(from_hex(CASE WHEN p.size = 0 THEN '' ELSE coalesce(f.h, q.h) END)) AS digest FROM p, range(6) r(k) LEFT JOIN f ON f.ref = p.ref AND f.part = k LEFT JOIN q ON q.ref = p.ref AND q.part = k
""")
def ec_encode(spark, d):
    return _coded(spark, d).select("ref", F.posexplode("fragments").alias("fragment", "f")).select("ref", F.col("fragment").cast("long").alias("fragment"), F.octet_length("f").cast("long").alias("size"), F.sha2("f", 256).alias("digest"))


@query("SELECT doc_id AS ref, sha256(coalesce(text, '')) AS chunk_id, true AS whole FROM documents")
def ec_decode(spark, d):
    """Two fragments are lost per chunk; the payload comes back."""
    lost = F.transform("fragments", lambda f, i: F.when((i != F.col("ref") % 6) & (i != (F.col("ref") + 2) % 6), f))
    back = _coded(spark, d).withColumn("back", coding.ec_decode(4, 2)(lost, F.octet_length("payload")))
    return back.select("ref", F.sha2("back", 256).alias("chunk_id"), (F.col("back") == F.col("payload")).alias("whole"))


@query("SELECT doc_id AS ref, CASE WHEN doc_id % 3 = 0 THEN 'stored' WHEN doc_id % 3 = 1 THEN 'decoded' ELSE 'lost' END AS path, CASE WHEN doc_id % 3 < 2 THEN sha256(coalesce(text, '')) END AS chunk_id FROM documents")
def degraded_read(spark, d):
    """With all devices online the stored bytes; else what the fragments left give."""
    down = F.when(F.col("ref") % 3 == 0, 0).when(F.col("ref") % 3 == 1, 2).otherwise(3)
    left = F.transform("fragments", lambda f, i: F.when(i >= down, f))
    read = _coded(spark, d).withColumn("back", F.when(down == 0, F.col("payload")).otherwise(coding.ec_decode(4, 2)(left, F.octet_length("payload"))))
    path = F.when(down == 0, "stored").when(F.col("back").isNull(), "lost").otherwise("decoded")
    return read.select("ref", path.alias("path"), F.sha2("back", 256).alias("chunk_id"))


@query("SELECT doc_id AS ref, i AS fragment, (doc_id + i) % 7 AS peer FROM documents, (VALUES (0::BIGINT), (1), (2), (3), (4), (5)) v(i)")
def ec_route(spark, d):
    """Fragment i goes to the i-th peer of the chunk's placement."""
    peers = F.array(*((F.col("ref") + i) % 7 for i in range(6)))
    routed = _coded(spark, d).select("ref", F.explode(F.arrays_zip(F.transform("fragments", lambda f, i: i).alias("i"), peers.alias("peer"))).alias("z"))
    return routed.select("ref", F.col("z.i").cast("long").alias("fragment"), F.col("z.peer").alias("peer"))


@query("SELECT doc_id AS ref, sha256(coalesce(text, '')) AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 1 END::BIGINT AS fragments FROM documents")
def ec_collect(spark, d):
    """Fragments as peers return them, put back by index and decoded; a replicated chunk is whole at index zero."""
    coded = _coded(spark, d)
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("payload").alias("f")))
    pieces = F.slice(F.transform("fragments", lambda f, i: F.struct(i.alias("i"), f.alias("f"))), 2, 4)
    sent = coded.select("ref", F.octet_length("payload").alias("n"), F.explode(F.when(F.col("ref") % 2 == 0, pieces).otherwise(whole)).alias("p"))
    got = sent.groupBy("ref", "n").agg(F.map_from_entries(F.collect_list(F.struct("p.i", "p.f"))).alias("m"))
    by_index = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("m")[i])
    back = F.when(F.col("ref") % 2 == 0, coding.ec_decode(4, 2)(by_index, F.col("n"))).otherwise(F.col("m")[F.lit(0)])
    return got.select("ref", F.sha2(back, 256).alias("chunk_id"), F.size("m").cast("long").alias("fragments"))


@query("SELECT doc_id AS ref, true AS aligned, sha256(coalesce(text, '')) AS chunk_id FROM documents")
def compress_pad(spark, d):
    padded = _docs(spark, d).select("ref", coding.compress_pad(512)(F.col("text").cast("binary")).alias("z"))
    return padded.select("ref", (F.octet_length("z") % 512 == 0).alias("aligned"), F.sha2(coding.unpad_decompress(1 << 24)("z"), 256).alias("chunk_id"))
