"""Tables of the model, projected from the input tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column | str) -> Column:
    """Milliseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ)) div 1000")


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """The ordered change log: one delta per event."""
    op = F.when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "signup", "Create").otherwise("Update")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("shard"), F.col("user_id").alias("key"), F.col("event_type").alias("consumer"),
        op.alias("op"), (F.col("event_type") == "error").alias("tombstone"), millis("ts").alias("at_ms"), F.floor("value").cast("long").alias("payload_size"),
    )


def consumers(spark: SparkSession, d: str) -> DataFrame:
    """Cursor of each consumer of the log."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("consumer")).agg(F.max("event_id").alias("position"))


def chunk_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to content-addressed chunks."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.sha2(text, 256).alias("chunk_id"), F.octet_length(text).cast("long").alias("size"), F.col("source").alias("tenant"))


def chunk_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("ref"), (F.col("quality") == 0).alias("tombstoned"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Names of objects by namespace."""
    return table(spark, d, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("ns"), F.regexp_extract("url", "^https?://[^/]+/?(.*)$", 1).alias("name"), F.col("page_id").alias("id"), F.octet_length("html").cast("long").alias("size")
    )


def locks(spark: SparkSession, d: str) -> DataFrame:
    """Byte-range locks; length zero reaches to the end of the file."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("file"), F.col("event_type").alias("owner"), (F.col("event_type") != "view").alias("write_lock"), F.col("event_id").alias("lock_id"),
        (F.col("event_id") % 1000).alias("off"), F.floor("value").cast("long").alias("len"), millis("ts").alias("acquired_ms"),
    )


def devices(spark: SparkSession, d: str) -> DataFrame:
    used = F.least(F.greatest(F.floor("s_acctbal").cast("long"), F.lit(0)), F.lit(10000)).cast("long")
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("device"), F.col("s_nationkey").cast("long").alias("pool"), F.lit(10000).cast("long").alias("capacity"), used.alias("used"), (F.col("s_suppkey") % 10 != 0).alias("online")
    )


def orgs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("org"), F.col("r_name").alias("org_name"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("project"), F.col("n_regionkey").cast("long").alias("org"), F.col("n_name").alias("project_name"))


def workloads(spark: SparkSession, d: str) -> DataFrame:
    quota = F.greatest(F.floor("c_acctbal").cast("long"), F.lit(0)).cast("long")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("workload"), F.col("c_nationkey").cast("long").alias("project"), quota.alias("quota"), F.col("c_mktsegment").alias("profile"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Events and metric points over time."""
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("event_type").alias("category"), severity.alias("severity"), millis("ts").alias("at_ms"), F.floor("value").cast("long").alias("amount")
    )


def ranges(spark: SparkSession, bounds: list[int]) -> DataFrame:
    """Shards by key range: consecutive half-open intervals; the last also takes the top key."""
    rows = [(i, a, b, i == len(bounds) - 2) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    return spark.createDataFrame(rows, "shard long, range_start long, range_end long, last boolean")
