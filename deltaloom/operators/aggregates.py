"""Cluster, capacity and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_summary(nodes: DataFrame, now_ms: int, interval_ms: int) -> DataFrame:
    """Sums of node counters; a snapshot older than one and a half intervals is unhealthy."""
    healthy = (F.lit(now_ms) - F.col("at_ms")) * 2 <= 3 * interval_ms
    counters = [c for c in nodes.columns if c not in ("node", "at_ms")]
    return nodes.agg(*(F.sum(c).alias(c) for c in counters), F.count("*").alias("nodes"), F.count_if(healthy).alias("healthy"))


def pool_state(used: Column, capacity: Column) -> Column:
    """By the whole per cent used; exact for any 64-bit sizes.  Without capacity: ok."""
    part, whole = used.cast("decimal(20,0)") * 100, capacity.cast("decimal(20,0)")
    over = lambda percent: (capacity != 0) & (part >= whole * percent)
    return F.when(over(95), "readonly").when(over(85), "critical").when(over(70), "warning").otherwise("ok")


def capacity_status(devices: DataFrame, *by: str) -> DataFrame:
    return devices.groupBy(*by).agg(F.sum("capacity").alias("capacity"), F.sum("used").alias("used"), F.count("*").alias("devices"), F.count_if("online").alias("online"))


def refcount(changes: DataFrame) -> DataFrame:
    """Per chunk the sum of +1 and -1 (``delta``), never below zero in the outcome, and whether it went below."""
    total = changes.groupBy("chunk").agg(F.sum("delta").alias("raw"))
    return total.select("chunk", F.greatest("raw", F.lit(0)).alias("refcount"), (F.col("raw") < 0).alias("underflow"))


def refcount_history(changes: DataFrame) -> DataFrame:
    """Running count per chunk in order of ``at`` (reflected at zero), tombstoned where it is zero."""
    order = Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.sum("delta").over(order)
    lowest = F.least(F.min("raw").over(order), F.lit(0))
    return changes.withColumn("raw", raw).withColumn("count", F.col("raw") - lowest).withColumn("tombstoned", F.col("count") == 0).drop("raw")


def inline_threshold(nodes: DataFrame, files: int, floor: int = 128, top: int = 65_536, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group ``by``, bytes up to which objects are kept inline: the tightest node's room over the number of files, clamped.

    A node over its hard limit brings the floor.  ``nodes``: total, used, hard.
    """
    tight = nodes.groupBy(*by).agg(F.max((F.col("used") > F.col("hard")).cast("int")).alias("over"), F.min(F.greatest(F.col("total") - F.col("used"), F.lit(0))).alias("room"))
    share = F.call_function("div", F.col("room"), F.lit(max(files, 1)).cast("long"))
    value = F.when(F.col("over") == 1, floor).otherwise(F.least(F.greatest(share, F.lit(floor)), F.lit(top)))
    reason = F.when(F.col("over") == 1, "hard_limit").when(share < floor, "floor").when(share > top, "ceiling").otherwise("computed")
    return tight.select(*by, value.cast("long").alias("threshold"), reason.alias("reason"))


def multipart_assemble(parts: DataFrame) -> DataFrame:
    """Objects from parts in order of arrival: size, number, and the ids joined."""
    ordered = F.sort_array(F.collect_list(F.struct("arrival", "part", "size")))
    return parts.groupBy("upload").agg(ordered.alias("p"), F.sum("size").alias("size")).select("upload", "size", F.size("p").cast("long").alias("parts"), F.array_join(F.transform("p", lambda x: x["part"].cast("string")), ",").alias("order"))


def kanon_saturation(rows: DataFrame, k: int = 5) -> DataFrame:
    """A group's value only where at least ``k`` distinct members share it, else -1."""
    return rows.groupBy("group").agg(F.when(F.count_distinct("member") < k, F.lit(-1.0)).otherwise(F.max("value").cast("double")).alias("saturation"))


def latency_percentiles(samples: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest rank: the sorted sample at min(n * p / 100, n - 1), whole-number division.

    Counts per distinct value first, so the window holds distinct values, not samples.
    """
    counts = samples.groupBy(by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(by))
    placed = counts.select(by, value, upto.alias("upto"), total.alias("n"))
    rank = lambda p: F.least(F.expr(f"n * {p} div 100"), F.col("n") - 1)
    return placed.groupBy(by).agg(F.first("n").alias("n"), *(F.min(F.when(F.col("upto") > rank(p), F.col(value))).alias(f"p{p}") for p in percents))


def max_clock_skew(samples: DataFrame, window: int, soft: int = 500, hard: int = 5_000) -> DataFrame:
    """Per peer, at every sample, the largest |local - remote| of the last ``window`` samples and its level."""
    recent = Window.partitionBy("peer").orderBy("at").rowsBetween(1 - window, 0)
    skew = F.max(F.abs(F.col("local") - F.col("remote"))).over(recent)
    level = F.when(F.col("skew") > hard, "hard").when(F.col("skew") > soft, "soft").otherwise("ok")
    return samples.withColumn("skew", skew).withColumn("level", level)


def metadata_budget(total: Column, used: Column, soft_percent: int, hard_percent: int) -> list[Column]:
    """Soft and hard limit in bytes and what is left under the soft one."""
    soft, hard = (F.call_function("div", total, F.lit(100)) * p + F.call_function("div", total % 100 * p, F.lit(100)) for p in (soft_percent, hard_percent))
    return [soft.alias("soft"), hard.alias("hard"), F.greatest(soft - used, F.lit(0)).cast("long").alias("budget")]


def progress(tasks: DataFrame, by: str) -> DataFrame:
    """Completed, failed and total per job; done once cancelled or nothing is open."""
    out = tasks.groupBy(by).agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count("*").alias("total"), F.bool_or("cancelled").alias("cancelled"))
    return out.withColumn("done", F.col("cancelled") | (F.col("completed") + F.col("failed") >= F.col("total")))


def histogram(rows: DataFrame, by: str, value: str, bounds: list[int]) -> DataFrame:
    """Cumulative bucket counts (le), count and sum per label."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds), F.count("*").alias("count"), F.sum(value).alias("sum"))


def metrics_text_scan(texts: DataFrame, exact: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """Counters of metric texts (node, text): lines ``name value``; blank and # lines are skipped.

    ``exact`` names assign (the last line counts), ``prefixes`` sum over labelled lines.
    A node without such lines, or without a text, has zeros.
    """
    lines = texts.select("node", F.posexplode_outer(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.when(~F.col("raw").startswith("#") & (F.trim("raw") != ""), F.col("raw")))
    parts = lines.select("node", "pos", F.substring_index("line", " ", 1).alias("key"), F.expr("try_cast(substring(line, instr(line, ' ') + 1) AS DOUBLE)").cast("long").alias("value"))
    out = [F.coalesce(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("pos"))), F.lit(0)).alias(n) for n, k in exact.items()]
    out += [F.coalesce(F.sum(F.when(F.col("key").startswith(k), F.col("value"))), F.lit(0)).alias(n) for n, k in prefixes.items()]
    return parts.groupBy("node").agg(*out)
