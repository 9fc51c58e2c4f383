"""Queries over version chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.operators import versions as v
from deltaloom.sources import model

from .registry import query

_CHAIN = """
, first AS (SELECT key, min(seq) AS s FROM deltas WHERE op <> 'Delete' GROUP BY 1),
chain AS (SELECT d.key, d.seq, d.at_ms, d.tombstone AS deleted, row_number() OVER (PARTITION BY d.key ORDER BY d.seq) AS version, lead(d.seq) OVER (PARTITION BY d.key ORDER BY d.seq) IS NULL AS current FROM deltas d JOIN first f ON d.key = f.key AND d.seq >= f.s)
"""


def _chain(spark, d):
    return v.version_chain(model.deltas(spark, d))


@query(_CHAIN + "SELECT key, seq, version, deleted, current FROM chain")
def version_chain(spark, d):
    return _chain(spark, d).drop("at_ms")


@query(_CHAIN + "SELECT key, seq, version FROM chain WHERE current AND NOT deleted")
def current_version(spark, d):
    return v.current_version(_chain(spark, d)).select("key", "seq", "version")


@query(_CHAIN + "SELECT key, seq, version FROM chain WHERE key = 8")
def list_versions(spark, d):
    return _chain(spark, d).filter("key = 8").orderBy(F.desc("version")).select("key", "seq", "version")


@query(_CHAIN + "SELECT key, seq, version FROM chain WHERE version = 5 AND NOT deleted")
def get_version(spark, d):
    return v.get_version(_chain(spark, d), 5).select("key", "seq", "version")


@query("SELECT pin::BIGINT AS pin, key, max(seq) AS seq FROM deltas, (VALUES (1, 300), (2, 2000), (3, 9000)) p(pin, position) WHERE seq <= position GROUP BY 1, 2")
def mvcc_pin(spark, d):
    pins = spark.createDataFrame([(1, 300), (2, 2000), (3, 9000)], "pin long, position long")
    return v.pinned_read(model.deltas(spark, d), pins)
