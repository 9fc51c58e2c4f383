"""Where queries over the table model register, with their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The table model in SQL: the same projections as ``deltaloom.sources.model``.
MODEL_SQL = """
WITH deltas AS (
  SELECT event_id AS seq, user_id % 4 AS shard, user_id AS key, event_type AS consumer,
         CASE event_type WHEN 'error' THEN 'Delete' WHEN 'signup' THEN 'Create' ELSE 'Update' END AS op,
         event_type = 'error' AS tombstone, epoch_us(ts) // 1000 AS at_ms, CAST(floor(value) AS BIGINT) AS payload_size
  FROM events),
consumers AS (SELECT event_type AS consumer, max(event_id) AS position FROM events GROUP BY 1),
chunk_refs AS (SELECT doc_id AS ref, sha256(coalesce(text, '')) AS chunk_id, strlen(coalesce(text, ''))::BIGINT AS size, source AS tenant FROM documents),
chunk_meta AS (SELECT doc_id AS ref, quality = 0 AS tombstoned FROM labels),
names AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS ns, regexp_extract(url, '^https?://[^/]+/?(.*)$', 1) AS name, page_id AS id, strlen(html)::BIGINT AS size FROM pages),
locks AS (SELECT user_id AS file, event_type AS owner, event_type <> 'view' AS write_lock, event_id AS lock_id, event_id % 1000 AS off, CAST(floor(value) AS BIGINT) AS len, epoch_us(ts) // 1000 AS acquired_ms FROM events),
devices AS (SELECT s_suppkey AS device, s_nationkey::BIGINT AS pool, 10000::BIGINT AS capacity, least(greatest(CAST(floor(s_acctbal) AS BIGINT), 0), 10000) AS used, s_suppkey % 10 <> 0 AS online FROM supplier),
org AS (SELECT r_regionkey::BIGINT AS org, r_name AS org_name FROM region),
project AS (SELECT n_nationkey::BIGINT AS project, n_regionkey::BIGINT AS org, n_name AS project_name FROM nation),
workload AS (SELECT c_custkey AS workload, c_nationkey::BIGINT AS project, greatest(CAST(floor(c_acctbal) AS BIGINT), 0) AS quota, c_mktsegment AS profile FROM customer),
history AS (SELECT event_id AS id, user_id AS source, event_type AS category, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity, epoch_us(ts) // 1000 AS at_ms, CAST(floor(value) AS BIGINT) AS amount FROM events)
"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a query; ``sql`` continues ``MODEL_SQL``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            # ``at`` is a column of the model and a keyword of the SQL dialect.
            ORACLES[key] = MODEL_SQL.replace("WITH", "WITH RECURSIVE", 1) + re.sub(r"\bat\b", '"at"', sql)
        return f

    return add
