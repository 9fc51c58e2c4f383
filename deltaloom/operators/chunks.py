"""Content-addressed chunks and objects: reads, splits, dedup, garbage collection, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_BYTES = 64 << 20


def chunk_state(refs: DataFrame) -> DataFrame:
    """State rows (tenant, chunk_id): number of references and size."""
    return refs.groupBy("tenant", "chunk_id").agg(F.count("*").alias("refcount"), F.max("size").alias("size"))


def object_read(parts: DataFrame, offset: int, length: int) -> DataFrame:
    """Bytes [offset, offset + length) of objects (id) that consist of ordered parts (pos, body); at or past the end: empty and eof.

    Every part knows from running sizes where it lies, and only the bytes inside
    the range are put together: a row never holds a whole object.
    """
    order = Window.partitionBy("id").orderBy("pos")
    n = F.octet_length("body").cast("long")
    placed = parts.select("id", "pos", F.col("body").cast("binary").alias("body"), n.alias("n")).withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.col("n")
    lo, hi = F.greatest(start, F.lit(offset)), F.least(F.col("end"), F.lit(offset + length))
    inside = F.substring(F.col("body"), (lo - start + 1).cast("int"), (hi - lo).cast("int"))
    cut = placed.select("id", "end", F.when(hi > lo, F.struct("pos", inside.alias("b"))).alias("piece"))
    whole = cut.groupBy("id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.max("end").alias("size"))
    data = F.aggregate("pieces", F.lit(b""), lambda acc, p: F.concat(acc, p["b"]))
    return whole.select("id", data.alias("data"), (F.col("size") <= offset + length).alias("eof"), "size")


def http_range(spec: Column, size: Column) -> dict[str, Column]:
    """Start, end (inclusive) and state of a byte-range header against a size.

    ``malformed`` where it is no byte range at all or a bound is over 64 bits,
    ``unsatisfiable`` for several ranges, reversed ones, or ones past the end.
    """
    spec = F.trim(spec)
    body = F.regexp_extract(spec, "^bytes=(.*)$", 1)
    a, b = F.regexp_extract(body, "^([0-9]*)-([0-9]*)$", 1), F.regexp_extract(body, "^([0-9]*)-([0-9]*)$", 2)
    start, end = a.try_cast("long"), b.try_cast("long")
    suffix = (a == "") & (b != "")
    lo = F.when(suffix, F.greatest(size - end, F.lit(0))).otherwise(start)
    hi = F.when(suffix | (b == ""), size - 1).otherwise(F.least(end, size - 1))
    overflow = (a != "") & start.isNull() | (b != "") & end.isNull()
    state = (
        F.when(~spec.rlike("^bytes="), "malformed")
        .when(body.contains(","), "unsatisfiable")
        .when(~body.rlike("^[0-9]*-[0-9]*$") | ((a == "") & (b == "")) | overflow, "malformed")
        .when(~suffix & (start >= size) | suffix & ((end == 0) | (size == 0)) | ~suffix & (b != "") & (end < start), "unsatisfiable")
        .otherwise("ok")
    )
    ok = state == "ok"
    return {"state": state, "first": F.when(ok, lo), "last": F.when(ok, hi)}


def object_write_split(objects: DataFrame, piece: int = PIECE_BYTES) -> DataFrame:
    """Pieces of at most ``piece`` bytes with their content ids; an empty object is one empty piece."""
    whole = objects.select("id", F.col("body").cast("binary").alias("body"))
    n = F.greatest(F.ceil(F.octet_length("body") / piece), F.lit(1))
    at = whole.select("id", "body", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("pos"))
    part = F.substring(F.col("body"), (F.col("pos") * piece + 1).cast("int"), F.lit(piece))
    return at.select("id", "pos", F.octet_length(part).cast("long").alias("size"), F.sha2(part, 256).alias("chunk_id"))


def list_objects(named: DataFrame, unnamed: DataFrame, prefix: str, start: int, max_keys: int) -> DataFrame:
    """A page of keys: names and the ids that no name covers, filtered, in order; the page tells where the next begins."""
    loose = unnamed.join(named.select("id").distinct(), "id", "left_anti").select(F.col("id").cast("string").alias("key"), "size")
    every = named.select(F.col("name").alias("key"), "size").unionByName(loose).filter(F.col("key").startswith(prefix))
    # One row beyond the page shows whether it is truncated.
    page = every.orderBy("key", "size").offset(start).limit(max_keys + 1)
    number = F.monotonically_increasing_id()
    total = page.agg(F.count("*").alias("found"))
    return page.withColumn("_n", number).filter(F.col("_n") < max_keys).drop("_n").crossJoin(F.broadcast(total)).select("key", "size", (F.col("found") > max_keys).alias("truncated"), F.when(F.col("found") > max_keys, F.lit(start + max_keys).cast("long")).alias("next"))


def dedup_write(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks after a batch of writes: how many references, which write comes first, and whether the chunk is new."""
    batch = refs.groupBy("chunk_id").agg(F.count("*").alias("refs"), F.min("ref").alias("first_ref"), F.max("size").alias("size"))
    known = store.select("chunk_id", F.col("refcount").alias("had"))
    joined = batch.join(known, "chunk_id", "left")
    return joined.select("chunk_id", "first_ref", "size", (F.col("refs") + F.coalesce("had", F.lit(0))).alias("refcount"), F.col("had").isNull().alias("is_new"))


def stored_bytes(size: Column, copies: int | None = None, data: int = 4, parity: int = 2) -> Column:
    """Bytes on disk: whole copies, or fragments of an erasure code."""
    return size * copies if copies else (data + parity) * F.ceil(size / data)


def chunk_gc(state: DataFrame) -> DataFrame:
    """Chunks without references and holds; what a pool gets back is the sum of their sizes."""
    return state.filter((F.col("refcount") == 0) & (F.size("holds") == 0))


def apply_holds(holds: Column, added: Column, removed: Column) -> Column:
    return F.array_sort(F.array_except(F.array_union(holds, added), removed))


def cache_outcome(bypass: Column, in_memory: Column, on_disk: Column) -> Column:
    return F.when(bypass, "bypass").when(in_memory, "l1").when(on_disk, "l2").otherwise("miss")


def small_object_put(puts: DataFrame, store: DataFrame) -> DataFrame:
    """Puts (key, value, at): the last value of each key and whether the key is new."""
    last = puts.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return last.join(store.select("key", F.lit(True).alias("had")), "key", "left").select("key", "value", F.col("had").isNull().alias("is_new"))


def small_object_log(ops: DataFrame) -> DataFrame:
    """What every operation (key, at, op, value) on a small-object store returns, in order of ``at`` per key.

    A put tells whether the key is ``new``, a delete whether it ``had`` one, a
    get its ``value``, a contains whether it is there.
    """
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    writes = F.when(F.col("op").isin("put", "delete"), F.struct((F.col("op") == "put").alias("held"), F.when(F.col("op") == "put", F.col("value")).alias("value")))
    state = ops.withColumn("_s", F.last(writes, ignorenulls=True).over(before))
    held = F.coalesce(F.col("_s.held"), F.lit(False))
    flag = F.when(F.col("op") == "put", ~held).when(F.col("op").isin("delete", "contains", "get"), held)
    return state.select("key", "at", "op", flag.alias("flag"), F.when((F.col("op") == "get") & held, F.col("_s.value")).alias("value"))


def small_object_len(ops: DataFrame) -> DataFrame:
    """Number of keys held, and the bytes of their values, after all operations."""
    last = ops.filter(F.col("op").isin("put", "delete")).groupBy("key").agg(F.max_by(F.struct("op", "value"), "at").alias("s")).filter("s.op = 'put'")
    return last.agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.octet_length(F.col("s.value").cast("string"))), F.lit(0)).cast("long").alias("bytes"))


def backup_retention(backups: DataFrame, now: int, days: int) -> DataFrame:
    """Backups (id, created, in seconds) to delete; zero days deletes all older than now."""
    return backups.filter(F.col("created") + days * 86_400 < now)


def hydrate(deltas: DataFrame) -> DataFrame:
    """Objects folded from Create, Update and Delete in order of seq.

    A second Create changes nothing, an Update to the value held does not raise
    the version, an Update or Delete of an unknown object is skipped.  One row
    per live object: value, version, last applied seq.
    """
    order = Window.partitionBy("key").orderBy("seq")
    lives = deltas.withColumn("_life", F.count_if(F.col("op") == "Delete").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    life = Window.partitionBy("key", "_life").orderBy("seq")
    created = F.min(F.when(F.col("op") == "Create", F.col("seq"))).over(Window.partitionBy("key", "_life"))
    known = lives.withColumn("_made", created).filter((F.col("op") == "Update") & (F.col("seq") > F.col("_made")) | (F.col("op") == "Create") & (F.col("seq") == F.col("_made")))
    changed = known.withColumn("_new", F.coalesce(F.lag("value").over(life) != F.col("value"), F.lit(True)))
    last_life = deltas.groupBy("key").agg(F.count_if(F.col("op") == "Delete").alias("_last"))
    alive = changed.join(last_life, "key").filter(F.col("_life") == F.col("_last"))
    return alive.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.count_if("_new").alias("version"), F.max(F.when(F.col("_new"), F.col("seq"))).alias("seq"))


def hydrate_outcomes(deltas: DataFrame) -> DataFrame:
    """Applied or skipped, per delta, by the rules of :func:`hydrate`."""
    order = Window.partitionBy("key").orderBy("seq")
    lives = deltas.withColumn("_life", F.count_if(F.col("op") == "Delete").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    made = F.min(F.when(F.col("op") == "Create", F.col("seq"))).over(Window.partitionBy("key", "_life"))
    known = F.coalesce(F.col("seq") > made, F.lit(False))
    outcome = F.when(F.col("op") == "Create", "Applied").when(known, "Applied").otherwise("PermanentSkip")
    return lives.select("seq", "key", "op", outcome.alias("outcome"))


def hydrate_poll(deltas: DataFrame, cursors: DataFrame, polls: int, threshold: int) -> DataFrame:
    """What becomes of every delta (shard, seq, op, key, ns) after ``polls`` polls from a shard's cursor (shard, position).

    Deltas are applied in order.  A Create needs its namespace registered
    earlier, unless its object lives already; an Update needs a live object;
    anything else is applied.  What is not met is transient: the poll stops
    there and the next one tries again, until the ``threshold``-th try, which
    skips it for good and goes on in the same poll.  A shard whose first delta
    is not the one after its cursor is halted.

    Outcomes: Applied, PermanentSkip, TransientSkip (the poll stands there, with
    its ``tries``), Pending (not reached), Halted.  No state is carried from
    delta to delta: the k-th transient delta of a shard is passed in poll
    k (threshold - 1) + 1.
    """
    new = deltas.join(cursors.select("shard", "position"), "shard").filter("seq > position")
    spaces = deltas.filter("op = 'NamespaceCreate'").groupBy(F.col("shard").alias("_s"), F.col("ns").alias("_ns")).agg(F.min("seq").alias("_registered"))
    known = deltas.join(spaces, (F.col("shard") == F.col("_s")) & (F.col("ns") == F.col("_ns")), "left").drop("_s", "_ns")
    order = Window.partitionBy("shard", "key").orderBy("seq")
    lives = known.withColumn("_life", F.count_if(F.col("op") == "Delete").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    made = F.min(F.when((F.col("op") == "Create") & (F.col("_registered") < F.col("seq")), F.col("seq"))).over(Window.partitionBy("shard", "key", "_life"))
    alive = F.coalesce(F.col("_made") < F.col("seq"), F.lit(False))
    reason = F.when((F.col("op") == "Create") & ~alive & ~F.coalesce(F.col("_registered") < F.col("seq"), F.lit(False)), "namespace_not_registered").when((F.col("op") == "Update") & ~alive, "update_before_create")
    judged = lives.withColumn("_made", made).withColumn("reason", reason).select("shard", "seq", "op", "key", "reason")
    judged = judged.join(new.select("shard", "seq", "position"), ["shard", "seq"])
    # Only the transient deltas of a shard are numbered.
    passed = (polls - 1) // (threshold - 1) if threshold > 1 else None
    tries = polls - passed * (threshold - 1) if passed is not None else 0
    first = judged.groupBy("shard").agg(F.min("seq").alias("_first"), F.min("position").alias("_from"))
    halted = first.select(F.col("shard").alias("_s"), (F.col("_first") > F.col("_from") + 1).alias("_halted"))
    if passed is None or polls < 1:
        stops = judged.select(F.col("shard").alias("_t"), F.lit(None if polls > 0 else -1).cast("long").alias("_stop")).distinct()
    else:
        number = F.row_number().over(Window.partitionBy("shard").orderBy("seq"))
        stuck = judged.filter("reason IS NOT NULL").withColumn("_k", number).filter(F.col("_k") == passed + 1)
        stops = stuck.select(F.col("shard").alias("_t"), F.col("seq").alias("_stop"))
    placed = judged.join(halted, F.col("shard") == F.col("_s")).join(stops, F.col("shard") == F.col("_t"), "left")
    outcome = (
        F.when(F.col("_halted"), "Halted").when(F.col("seq") > F.col("_stop"), "Pending").when(F.col("seq") == F.col("_stop"), "TransientSkip").when(F.col("reason").isNotNull(), "PermanentSkip").otherwise("Applied")
    )
    done = placed.withColumn("outcome", outcome)
    why = F.when(F.col("outcome") == "TransientSkip", F.col("reason")).when(F.col("outcome") == "PermanentSkip", F.lit("exhausted_retries"))
    return done.select("shard", "seq", "op", "key", "outcome", why.alias("reason"), F.when(F.col("outcome") == "TransientSkip", F.lit(tries)).cast("long").alias("tries"))


def hydrate_cursor(outcomes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per shard where the next poll begins, where it is stuck and how often it tried, and whether it is halted; from :func:`hydrate_poll`."""
    done = outcomes.groupBy("shard").agg(
        F.max(F.when(F.col("outcome").isin("Applied", "PermanentSkip"), F.col("seq"))).alias("_top"), F.max(F.when(F.col("outcome") == "TransientSkip", F.col("seq"))).alias("stuck_at"),
        F.max("tries").alias("tries"), F.bool_or(F.col("outcome") == "Halted").alias("halted"),
    )
    return cursors.join(done, "shard", "left").select("shard", F.coalesce("_top", "position").alias("position"), "stuck_at", "tries", F.coalesce("halted", F.lit(False)).alias("halted"))


def names_index(outcomes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Names (ns, name) and the object each stands for after the applied deltas.

    An applied Create binds its name, again if the object lives already; the
    Delete of the object that a name stands for unbinds it.
    """
    applied = deltas.join(outcomes.filter("outcome = 'Applied'").select("shard", "seq"), ["shard", "seq"])
    bound = applied.filter("op = 'Create' AND name IS NOT NULL").groupBy("shard", "ns", "name").agg(F.max(F.struct("seq", "key")).alias("b"))
    gone = applied.filter("op = 'Delete'").groupBy(F.col("shard").alias("_s"), F.col("key").alias("_k")).agg(F.max("seq").alias("_gone"))
    held = bound.join(gone, (F.col("shard") == F.col("_s")) & (F.col("b.key") == F.col("_k")), "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("b.seq")))
    return held.select("shard", "ns", "name", F.col("b.key").alias("key"))


def chunk_states(commands: DataFrame) -> DataFrame:
    """State per (tenant, chunk) after commands (tenant, chunk, at, command, placement, original_len) in order of ``at``.

    ``create`` makes an entry with one reference where none is, ``increment``
    adds one and revives, ``decrement`` takes one, not below zero, and tombstones
    at zero.  Before its creation a chunk knows neither.  The count is the walk
    of the steps reflected at zero, so no state is carried.
    """
    key = ["tenant", "chunk"]
    made = commands.filter("command = 'create'").groupBy(*key).agg(F.min(F.struct("at", "placement", "original_len")).alias("m"))
    later = commands.filter("command <> 'create'").join(made.select(*key, F.col("m.at").alias("_made")), key).filter(F.col("at") > F.col("_made"))
    steps = later.select(*key, "at", F.when(F.col("command") == "increment", 1).otherwise(-1).cast("long").alias("step")).unionByName(made.select(*key, F.col("m.at").alias("at"), F.lit(1).cast("long").alias("step")))
    order = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    walk = steps.withColumn("_raw", F.sum("step").over(order))
    walk = walk.withColumn("_n", F.col("_raw") - F.least(F.min("_raw").over(order), F.lit(0)))
    last = walk.groupBy(*key).agg(F.max_by("_n", "at").alias("refcount"))
    return last.join(made, key).select(*key, "refcount", (F.col("refcount") == 0).alias("tombstoned"), F.col("m.at").alias("created_at"), "m.placement", "m.original_len")
