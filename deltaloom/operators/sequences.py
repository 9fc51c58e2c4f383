"""Per-key ordered operators: islands, sliding windows, state transitions, running limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

#: The largest logical part of a clock (32 bits), and the largest physical one that a long holds.
LOGICAL_TOP = (1 << 32) - 1
PHYSICAL_TOP = (1 << 63) - 1


def sequential_reads(reads: DataFrame, suggest_after: int = 3, ahead: int = 262_144) -> DataFrame:
    """Length of the sequential run at each read (file, at, off, len) and, from the third on, the prefetch offset."""
    order = Window.partitionBy("file").orderBy("at")
    prev_end, prev_len = F.lag(F.col("off") + F.col("len")).over(order), F.lag("len").over(order)
    goes_on = F.coalesce((F.col("off") == prev_end) & (prev_len > 0), F.lit(False))
    island = F.sum((~goes_on).cast("int")).over(order)
    runs = reads.withColumn("island", island).withColumn("run", F.row_number().over(Window.partitionBy("file", "island").orderBy("at")).cast("long"))
    hint = F.col("run") >= suggest_after
    return runs.select("file", "at", "run", F.when(hint, F.col("off") + F.col("len")).alias("prefetch_off"), F.when(hint, F.lit(ahead)).cast("long").alias("prefetch_len"))


def phase_monotonic(advances: DataFrame, keep: int) -> DataFrame:
    """Accepted phases of each workflow (each above all before it) and which of them the bounded history keeps."""
    before = F.max("phase").over(Window.partitionBy("workflow").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ok = advances.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("phase") > F.col("_before"))).drop("_before")
    newest = F.row_number().over(Window.partitionBy("workflow").orderBy(F.desc("at")))
    return ok.withColumn("kept", newest <= keep)


def ring_last_n(rows: DataFrame, by: str, at: str, n: int) -> DataFrame:
    newest = Window.partitionBy(by).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def circuit_trip(calls: DataFrame, window_ms: int = 30_000, limit: int = 5) -> DataFrame:
    """Failures of the last ``window_ms`` since the last success, per transport, and whether the circuit opens."""
    order = Window.partitionBy("transport").orderBy("at_ms", "id")
    era = F.sum((~F.col("failed")).cast("int")).over(order)
    recent = Window.partitionBy("transport", "era").orderBy("at_ms").rangeBetween(-window_ms, 0)
    return calls.withColumn("era", era).withColumn("failures", F.count_if("failed").over(recent)).withColumn("open", F.col("failed") & (F.col("failures") >= limit)).drop("era")


def breaker_consecutive(calls: DataFrame, limit: int = 3) -> DataFrame:
    """Failures in a row at each call and whether the breaker is open after it."""
    order = Window.partitionBy("transport").orderBy("at_ms", "id")
    era = F.sum((~F.col("failed")).cast("int")).over(order)
    streak = F.sum(F.col("failed").cast("long")).over(Window.partitionBy("transport", "era").orderBy("at_ms", "id"))
    return calls.withColumn("era", era).withColumn("streak", streak).withColumn("open", F.col("streak") >= limit).drop("era")


#: Allowed changes of a device's state.
TRANSITIONS = (("Online", "Draining"), ("Online", "Offline"), ("Offline", "Online"), ("Draining", "Decommissioned"))


def device_transitions(states: DataFrame) -> DataFrame:
    """Every change of state (device, at, state) with whether it is allowed."""

    def step(held: dict, row: dict) -> list[tuple]:
        before, after = held.get("state"), row["state"]
        allowed = before is None or (before, after) in TRANSITIONS
        if allowed:
            held["state"] = after
        return [] if before is None else [(row["at"], after, before, allowed)]

    return fold(states.select("device", "at", "state"), ["device"], ["at"], "at long, state string, before string, allowed boolean", dict, step)


def survivors(entries: DataFrame, budget: int) -> DataFrame:
    """What a least-recently-used cache of ``budget`` bytes holds in the end: pinned entries, then the newest that fit.

    Sizes count from the newest on; the first that does not fit and all older ones are gone.
    """
    order = Window.partitionBy("cache").orderBy(F.desc("pinned"), F.desc("at"), "entry").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_sum", F.sum("size").over(order)).filter(F.col("pinned") | (F.col("_sum") <= budget)).drop("_sum")


def newest_entries(entries: DataFrame, by: str, at: str, entry: str, limit: int) -> DataFrame:
    """What a cache of ``limit`` entries holds in the end if the oldest goes first; ties by entry."""
    newest = Window.partitionBy(by).orderBy(F.desc(at), F.desc(entry))
    return entries.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit).drop("_n")


def token_bucket(calls: DataFrame, per_second: int) -> DataFrame:
    """Admission in fixed windows of a second: the first ``per_second`` calls of each owner pass."""
    second = F.floor(F.col("at_ms") / 1000)
    n = F.row_number().over(Window.partitionBy("owner", "second").orderBy("at_ms", "id"))
    return calls.withColumn("second", second).withColumn("admitted", n <= per_second)


def extent_coalesce(extents: DataFrame) -> DataFrame:
    """Adjacent extents (volume, off, len) made one."""
    order = Window.partitionBy("volume").orderBy("off")
    broken = F.coalesce(F.lag(F.col("off") + F.col("len")).over(order) != F.col("off"), F.lit(True))
    runs = extents.withColumn("_run", F.sum(broken.cast("int")).over(order))
    return runs.groupBy("volume", "_run").agg(F.min("off").alias("off"), F.sum("len").alias("len"), F.count("*").alias("merged")).drop("_run")


def latency_ema(samples: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Exponential mean 0.2 x + 0.8 prev, cut to whole units at every step; the first sample starts it."""

    def step(mean: list[int], row: dict) -> tuple:
        x = int(row[value])
        mean[:] = [(x + mean[0] * 4) // 5 if mean else x]
        return ()

    return fold(samples.select(by, at, value), [by], [at, value], "ema long", list, step, lambda mean: [(mean[0],)])


def write_batches(writes: DataFrame, by: str, at: str, size: str, limit: int, delay: int | None = None) -> DataFrame:
    """Batches in order of arrival, closed once they reach ``limit`` bytes.

    With a ``delay`` (in units of ``at``) a batch is also closed before a write
    that comes so long after its first.  Writes of zero bytes open a batch too.
    """

    class Open:
        first, bytes, batches = None, 0, 0

        def flush(self) -> tuple:
            done = (self.batches, self.bytes)
            self.first, self.bytes, self.batches = None, 0, self.batches + 1
            return done

    def step(o: Open, row: dict) -> list[tuple]:
        out = [o.flush()] if o.first is not None and delay is not None and row[at] - o.first >= delay else []
        o.first, o.bytes = row[at] if o.first is None else o.first, o.bytes + row[size]
        return [*out, o.flush()] if o.bytes >= limit else out

    return fold(writes.select(by, at, size), [by], [at, size], "batch long, bytes long", Open, step, lambda o: [] if o.first is None else [o.flush()])


def workflow_slots(changes: DataFrame, most: int) -> DataFrame:
    """Declarations and releases (owner, at, declares) under a cap: what is admitted and how many are active after it.

    A declaration beyond the cap is refused; a release with none active changes nothing.
    """

    def step(held: list[int], row: dict) -> list[tuple]:
        n = held[0]
        admitted = n < most if row["declares"] else n > 0
        held[0] = n + (1 if row["declares"] else -1) * admitted
        return [(row["at"], row["declares"], admitted, held[0])]

    return fold(changes.select("owner", "at", "declares"), ["owner"], ["at"], "at long, declares boolean, admitted boolean, active long", lambda: [0], step)


def hlc_tick(events: DataFrame) -> DataFrame:
    """Strictly rising hybrid clock per node over local events (node, at, physical).

    The clock never falls behind the largest physical time seen; while that
    stands still, the logical part counts.  One top time with 2**32 events on a
    node carries into the physical part.
    """
    order = Window.partitionBy("node").orderBy("at")
    top = F.max("physical").over(order.rowsBetween(Window.unboundedPreceding, 0))
    with_top = events.withColumn("top", top)
    logical = F.row_number().over(Window.partitionBy("node", "top").orderBy("at")) - 1
    logical = logical.cast("long")
    carried = F.shiftright(logical, 32)
    return with_top.select("node", "at", (F.col("top") + carried).alias("physical"), logical.bitwiseAND(F.lit(LOGICAL_TOP)).alias("logical"))


def hlc_next(physical: Column, logical: Column) -> Column:
    """The next clock: a full logical part carries into the physical one; null if that is full too."""
    carries = logical >= LOGICAL_TOP
    step = F.struct(F.when(carries, physical + 1).otherwise(physical).alias("physical"), F.when(carries, 0).otherwise(logical + 1).cast("long").alias("logical"))
    return F.when(~(carries & (physical >= PHYSICAL_TOP)), step)


def hlc_merge(local: Column, remote: Column, now: Column) -> Column:
    """Clock after a message: all three physical times compete, the logical part follows the winner; null when exhausted."""
    top = F.greatest(local["physical"], remote["physical"], now)
    base = (
        F.when((top == local["physical"]) & (top == remote["physical"]), F.greatest(local["logical"], remote["logical"]))
        .when(top == local["physical"], local["logical"])
        .when(top == remote["physical"], remote["logical"])
    )
    return F.when(base.isNull(), F.struct(top.alias("physical"), F.lit(0).cast("long").alias("logical"))).otherwise(hlc_next(top, base))
