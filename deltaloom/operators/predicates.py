"""Conjunctive filters and row predicates.

Now is always an argument, so results do not depend on when a query runs.
Every bound is strict or inclusive exactly as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: The severities and categories that a request may name.
KNOWN_SEVERITIES = ("info", "warning", "error", "critical")
KNOWN_CATEGORIES = ("node", "shard", "device", "tenant", "security", "admin", "gateway", "raft")


def audit_query(events: DataFrame, tenant: str | None, first_seq: int = 0, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """A tenant's events (null: the system's) from a sequence number on, optionally of one kind, the first ``limit``."""
    found = events.filter(F.col("tenant").eqNullSafe(F.lit(tenant)) & (F.col("seq") >= first_seq))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    found = found.orderBy("seq")
    return found if limit is None else found.limit(limit)


def event_query(events: DataFrame, now_ms: int, hours: int, severity: str | None = None, category: str | None = None) -> DataFrame:
    """Events not older than ``hours``."""
    found = events.filter(F.col("at_ms") >= now_ms - hours * HOUR_MS)
    for name, value in (("severity", severity), ("category", category)):
        if value is not None:
            found = found.filter(F.col(name) == value)
    return found


def event_api(events: DataFrame, now_ms: int, hours: float = 3, severity: str | None = None, category: str | None = None, limit: int = 100) -> DataFrame:
    """As :func:`event_query`, newest first; an unknown severity or category filters nothing."""
    known = [value if value in values else None for value, values in ((severity, KNOWN_SEVERITIES), (category, KNOWN_CATEGORIES))]
    return event_query(events, now_ms, hours, *known).orderBy(F.desc("at_ms"), F.desc("id")).limit(limit)


def history_since(points: DataFrame, now_ms: int, hours: int) -> DataFrame:
    return points.filter(F.col("at_ms") >= now_ms - hours * HOUR_MS)


def write_conditional(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Verdict of conditional writes (name, if_none_match, if_match) against names (name, etag)."""
    joined = requests.join(names, "name", "left")
    verdict = (
        F.when((F.col("if_none_match") == "*") & F.col("etag").isNotNull(), "exists")
        .when(F.col("if_match").isNotNull() & F.col("etag").isNull(), "missing")
        .when(F.col("if_match").isNotNull() & (F.col("if_match") != F.col("etag")), "changed")
        .otherwise("proceed")
    )
    return joined.withColumn("verdict", verdict)


def access_active(now_ms: int, state: Column, approved_ms: Column, hours: Column) -> Column:
    """Approved, and now strictly before the end."""
    return (state == "Approved") & (F.lit(now_ms) < approved_ms + hours * HOUR_MS)


def ttl_expired(elapsed: Column, ttl: Column) -> Column:
    """A time to live of zero never ends; else strictly over it."""
    return (ttl > 0) & (elapsed > ttl)


def cache_fresh(age: Column, ttl: Column) -> Column:
    """At the time to live still fresh."""
    return age <= ttl


def key_cache_expired(elapsed: Column, ttl: Column) -> Column:
    """At the time to live already expired."""
    return elapsed >= ttl


def disconnected(elapsed: Column, threshold: Column) -> Column:
    return elapsed > threshold


def valid_cache_ttl(seconds: Column) -> Column:
    return seconds.between(5, 300)


def live_pins(pins: Column, now_ms: int) -> Column:
    """Pins (acquired_ms, ttl_ms) not past their time; the end itself still counts."""
    return F.filter(pins, lambda p: F.lit(now_ms) - p["acquired_ms"] <= p["ttl_ms"])


def staleness_lag(now_ms: int, advanced_ms: Column, max_ms: Column) -> Column:
    """The lag where it is over the bound, else null."""
    lag = F.lit(now_ms) - advanced_ms
    return F.when(lag > max_ms, lag)


def pool_thresholds(warning: Column, critical: Column, readonly: Column, target: Column) -> Column:
    """First violated rule of pool thresholds; zero means unset (70, 85, 95)."""
    w, c, r = (F.when(x == 0, d).otherwise(x) for x, d in ((warning, 70), (critical, 85), (readonly, 95)))
    bad = lambda x, lo, hi: (x != 0) & ~x.between(lo, hi)
    return (
        F.when(bad(warning, 50, 95), "warning").when(bad(critical, 60, 98), "critical").when(bad(readonly, 70, 99), "readonly").when(bad(target, 50, 90), "target").when(~((w < c) & (c < r)), "order").otherwise("ok")
    )


def tuning_ranges(settings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Settings (name, value) with whether they lie in the inclusive bounds (name, lo, hi); unknown names are not ok."""
    return settings.join(F.broadcast(bounds), "name", "left").withColumn("ok", F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False)))


def retention_held(objects: DataFrame, holds: DataFrame) -> DataFrame:
    """Objects whose namespace has an active hold."""
    return objects.join(holds.filter("active").select("ns").distinct(), "ns", "left_semi")


def in_scope(rows: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Rows whose key is owned; missing and foreign keys look alike."""
    return rows.join(owned.select(key).distinct(), key, "left_semi")
