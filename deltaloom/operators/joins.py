"""Scrubs, lookups, range and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import small

DAY_MS = 86_400_000


def orphan_scrub(local: DataFrame, meta: DataFrame, age_limit_ms: int = DAY_MS) -> DataFrame:
    """Decision per local chunk (ref, age_ms): kept with live metadata, young, or deleted.  Tombstoned metadata counts as none."""
    live = meta.filter("not tombstoned").select("ref", F.lit(True).alias("live"))
    decision = F.when(F.col("live"), "Keep").when(F.col("age_ms") < age_limit_ms, "KeepYoung").otherwise("Delete")
    return local.join(live, "ref", "left").select("ref", decision.alias("decision"))


def replica_health(placement: DataFrame, presence: DataFrame, target: int, min_acks: int) -> DataFrame:
    """Per chunk (placement: chunk, peers in order) the healthy peers and a verdict; a chunk placed nowhere is lost."""
    wanted = placement.select("chunk", F.size("peers").alias("width"), F.posexplode_outer("peers").alias("pos", "peer"))
    seen = wanted.join(presence.select("chunk", "peer", F.lit(True).alias("here")), ["chunk", "peer"], "left")
    here = F.coalesce("here", F.lit(False))
    out = seen.groupBy("chunk").agg(
        F.first("width").cast("long").alias("width"), F.count_if(here).alias("healthy"),
        F.min_by("peer", F.when(here, F.col("pos"))).alias("source"), F.min_by("peer", F.when(~here, F.col("pos"))).alias("missing"),
        F.sort_array(F.collect_list(F.when(here, F.struct("pos", "peer")))).alias("sources"),
    )
    verdict = F.when(F.col("healthy") == 0, "Lost").when(F.col("healthy") < min_acks, "Critical").when((F.col("healthy") < target) & (F.col("healthy") < F.col("width")), "Repair").otherwise("Healthy")
    return out.withColumn("verdict", verdict)


def repair_plan(health: DataFrame) -> DataFrame:
    """One copy per chunk and pass: the first healthy peer to the first missing one."""
    return health.filter(F.col("verdict").isin("Critical", "Repair")).select("chunk", F.col("source").alias("from"), F.col("missing").alias("to"))


def repair_plan_ec(health: DataFrame) -> DataFrame:
    """All healthy fragments and the first missing one."""
    return health.filter(F.col("verdict").isin("Critical", "Repair")).select("chunk", F.transform("sources", lambda s: s["peer"]).alias("from"), F.col("missing").alias("to"))


def extent_orphans(allocated: DataFrame, referenced: DataFrame) -> DataFrame:
    """Extents that are allocated but not referenced, or referenced but not allocated."""
    a, r = allocated.select("extent", F.lit(True).alias("a")), referenced.select("extent", F.lit(True).alias("r"))
    return a.join(r, "extent", "full_outer").filter(F.col("a").isNull() | F.col("r").isNull()).select("extent", F.when(F.col("r").isNull(), "orphan").otherwise("unallocated").alias("fault"))


def sampled(index: Column, n: Column, per_mille: int) -> Column:
    """Multiplicative-hash sampling of ``n`` items."""
    return F.pmod(index.cast("decimal(20,0)") * F.lit(2_654_435_761).cast("decimal(10,0)"), n.cast("decimal(20,0)")) * 1000 < n.cast("decimal(20,0)") * per_mille


def extent_scrub(extents: DataFrame, referenced: DataFrame, per_mille: int) -> DataFrame:
    """One report per device over extents (device, extent, primary, mirror, crc_ok; extents count from 0).

    ``bitmap_errors``: primary and mirror differ (a null mirror is not compared);
    ``orphan_extents``: allocated in the primary, not in ``referenced`` (device,
    extent); ``crc_failures``: allocated, in the sample of the device's extents,
    and failing.
    """
    sizes = extents.groupBy(F.col("device").alias("_d")).agg(F.count("*").alias("_n"))
    known = referenced.select("device", "extent", F.lit(True).alias("_r")).distinct()
    rows = extents.join(known, ["device", "extent"], "left").join(sizes, F.col("device") == F.col("_d"))
    allocated = F.col("primary") != 0
    return rows.groupBy("device").agg(
        F.count_if(F.col("primary") != F.col("mirror")).alias("bitmap_errors"), F.count_if(allocated & F.col("_r").isNull()).alias("orphan_extents"),
        F.count_if(allocated & sampled(F.col("extent"), F.col("_n"), per_mille) & ~F.col("crc_ok")).alias("crc_failures"), F.count("*").alias("extents_checked"),
    )


def route_to_shard(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keys with the shard whose range holds them; all ranges but the last end before their end.  Keys outside all are left out.

    ``ranges`` is one row per shard: each key searches them inside its row.
    """
    rest = [c for c in ranges.columns if c not in ("range_start", "range_end", "last")]
    table = small.constants(ranges, "range_start", "range_end", "last", *rest)
    holds = F.filter(table, lambda r: (F.col("key") >= r["range_start"]) & ((F.col("key") < r["range_end"]) | r["last"]))
    found = keys.withColumn("_r", F.try_element_at(holds, F.lit(1))).filter(F.col("_r").isNotNull())
    return found.select(*keys.columns, *(F.col("_r").getField(c).alias(c) for c in rest))


def version_at_time(probes: DataFrame, chain: DataFrame) -> DataFrame:
    """As-of: for (key, at_ms) the last appended version whose time is not after it; none if that is a deletion.

    Times need not rise with versions: what counts is the greatest version.
    Probes and versions are merged into one ordered run per key: one shuffle,
    no pairs, whatever the number of versions.
    """
    v = chain.select("key", "at_ms", F.struct("version", "deleted", "seq").alias("v"), F.lit(None).cast("long").alias("probe"), F.lit(0).alias("kind"))
    q = probes.select("key", "at_ms", F.lit(None).cast(v.schema["v"].dataType).alias("v"), "probe", F.lit(1).alias("kind"))
    order = Window.partitionBy("key").orderBy("at_ms", "kind").rowsBetween(Window.unboundedPreceding, 0)
    best = v.unionByName(q).withColumn("best", F.max("v").over(order)).filter("kind = 1")
    return best.select("probe", "key", F.when(~F.col("best.deleted"), F.col("best.version")).alias("version"), F.when(~F.col("best.deleted"), F.col("best.seq")).alias("seq"))


def hierarchy(workloads: DataFrame, projects: DataFrame, orgs: DataFrame) -> DataFrame:
    return workloads.join(projects, "project", "left").join(orgs, "org", "left")


#: Bits of the cell sizes; the last holds any range, those to the end of a file among them.
LOCK_LEVELS = (6, 12, 18, 24, 30, 36, 42, 48, 54, 62)


def lock_conflicts(requests: DataFrame, held: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    """Pairs (request, holder) that conflict: same file, overlapping ranges, unexpired, other owner, one writes.

    Cells of the offset come in sizes.  A range's own size is the first that it
    does not exceed, so it touches two cells there, and in every larger size,
    whatever its length; a pair meets once, in the larger of its two own sizes,
    in the first cell that both touch.  The join is on file, size and cell.
    Ranges of length zero reach to the end of the file.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        end = F.when(F.col("len") == 0, F.lit(2**62)).otherwise(F.least(F.col("off") + F.col("len"), F.lit(2**62)))
        flat = df.select("file", *(F.col(c).alias(p + c) for c in ("lock_id", "owner", "write_lock", "off")), end.alias(p + "end"))
        own = F.lit(LOCK_LEVELS[-1])
        for level in reversed(LOCK_LEVELS[:-1]):
            own = F.when(F.col(p + "end") - F.col(p + "off") <= 1 << level, level).otherwise(own)
        first, last = (lambda bits, c=c: F.shiftright(c, bits) for c in (F.col(p + "off"), F.col(p + "end") - 1))
        sizes = F.array(*(F.when(own <= x, F.struct(F.lit(x).alias("level"), (own == x).alias("own"), first(x).alias("first"), last(x).alias("last"))) for x in LOCK_LEVELS))
        at = flat.withColumn("_s", F.explode(F.filter(sizes, lambda x: x.isNotNull())))
        return at.select(*flat.columns, F.col("_s.level").alias("level"), F.col("_s.own").alias(p + "own"), F.col("_s.first").alias(p + "first"), F.explode(F.sequence("_s.first", "_s.last")).alias("cell"))

    a, b = cells(requests, "a_"), cells(held.filter(F.lit(now_ms) - F.col("acquired_ms") <= lease_ms), "b_")
    hit = (F.col("a_off") < F.col("b_end")) & (F.col("b_off") < F.col("a_end")) & (F.col("a_owner") != F.col("b_owner")) & (F.col("a_write_lock") | F.col("b_write_lock"))
    once = (F.col("a_own") | F.col("b_own")) & (F.col("cell") == F.greatest("a_first", "b_first"))
    return a.join(b, ["file", "level", "cell"]).filter(once & hit).select("file", F.col("a_lock_id").alias("request"), F.col("b_lock_id").alias("holder"))


def layout_covers(layouts: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether a file's layout segments span (off, len) of a request; length zero asks for one byte."""
    span = layouts.groupBy("file").agg(F.min("off").alias("lo"), F.max(F.col("off") + F.col("len")).alias("hi"))
    covers = (F.col("lo") <= F.col("off")) & (F.col("hi") >= F.col("off") + F.greatest(F.col("len"), F.lit(1)))
    return requests.join(span, "file", "left").withColumn("covers", F.coalesce(covers, F.lit(False)))


def pool_delete_guard(pools: DataFrame, devices: DataFrame) -> DataFrame:
    """Pools that no device refers to."""
    return pools.join(devices.select("pool").distinct(), "pool", "left_anti")


def ref_outcome(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of requests by how their reference fares: absent, valid, invalid."""
    k = known.select(F.col("ref").alias("k")).distinct()
    outcome = F.when(F.col("ref").isNull(), "absent").when(F.col("k").isNotNull(), "valid").otherwise("invalid")
    return requests.join(k, F.col("ref") == F.col("k"), "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
