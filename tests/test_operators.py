"""Boundaries, nulls and properties on small hand-made tables."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom.functions import coding, scalar
from deltaloom.operators import aggregates, chunks, joins, log, placement, policy, predicates, sequences, versions
from deltaloom.streaming import view

DELTA = "seq long, shard long, key long, op string, tombstone boolean, at_ms long, payload_size long"


def deltas(spark, rows):
    return spark.createDataFrame([(s, 0, k, op, op == "Delete", s * 10, 5) for s, k, op in rows], DELTA)


def pick(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_boundary_and_stalled_consumers(spark):
    c = spark.createDataFrame([("sp-nfs", 9500), ("sp-s3", 8000), ("audit", 9000)], "consumer string, position long")
    assert log.gc_boundary(c).first().boundary == 8000
    assert log.gc_boundary(c.limit(0)).first().boundary is None
    s = spark.createDataFrame([("a", 50000), ("b", 55000), ("c", 52000), ("analytics", 1000)], "consumer string, position long")
    assert [r.consumer for r in log.stalled_consumers(s, 10_000).collect()] == ["analytics"]
    moved = log.consumer_advance(c.limit(0), spark.createDataFrame([("x", 100), ("x", 50), ("x", 999)], "consumer string, position long"), buffered=999)
    assert pick(moved, "consumer", "position") == [("x", 100)]


def test_compaction_keeps_tombstones_until_the_boundary(spark):
    d = deltas(spark, [(1, 1, "Create"), (2, 1, "Update"), (3, 2, "Create"), (4, 2, "Delete"), (5, 3, "Delete")])
    edge = lambda n: spark.createDataFrame([(n,)], "boundary long")
    assert pick(log.compact_latest(d, edge(0)), "seq") == [(2,), (4,), (5,)]
    assert pick(log.compact_latest(d, edge(5)), "seq") == [(2,), (5,)]  # strictly below the boundary
    assert pick(log.compact_latest(d, edge(None)), "seq") == [(2,), (4,), (5,)]
    once = log.compact_latest(d, edge(5))
    assert pick(log.compact_latest(once, edge(5)), "seq") == pick(once, "seq")
    assert pick(log.compact_versions(d, 0), "seq") == [(2,)]
    assert pick(log.compact_versions(d, 2), "seq") == [(1,), (2,), (3,)]
    assert log.compact_latest(d.limit(0), edge(1)).count() == 0


def test_range_scan_refuses_empty_ranges(spark):
    with pytest.raises(ValueError, match="empty range"):
        log.log_range_scan(deltas(spark, []), 0, 5, 4)


def test_gap_rules(spark):
    g = spark.createDataFrame([("new", None, 0), ("new1", None, 1), ("ok", 4, 5), ("gap", 4, 6)], "peer string, last_seq long, expected long")
    assert pick(log.cdc_gap_check(g), "peer", "gap") == [("gap", True), ("new", False), ("new1", True), ("ok", False)]


def test_time_bounds(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(predicates.cache_fresh(F.lit(5), F.lit(5))) and not value(predicates.key_cache_expired(F.lit(4), F.lit(5))) and value(predicates.key_cache_expired(F.lit(5), F.lit(5)))
    assert not value(predicates.ttl_expired(F.lit(5), F.lit(5))) and value(predicates.ttl_expired(F.lit(6), F.lit(5))) and not value(predicates.ttl_expired(F.lit(9), F.lit(0)))
    assert not value(predicates.access_active(3_600_000, F.lit("Approved"), F.lit(0), F.lit(1))) and value(predicates.access_active(3_599_999, F.lit("Approved"), F.lit(0), F.lit(1)))
    pins = F.array(F.struct(F.lit(1000).alias("acquired_ms"), F.lit(5000).alias("ttl_ms")))
    assert [value(F.size(predicates.live_pins(pins, t))) for t in (3000, 6000, 6001)] == [1, 1, 0]
    assert value(predicates.staleness_lag(2500, F.lit(1000), F.lit(2000))) is None and value(predicates.staleness_lag(4000, F.lit(1000), F.lit(2000))) == 3000


def test_null_tenant_is_the_system(spark):
    e = spark.createDataFrame([(1, None, "w"), (2, "t", "r"), (3, None, "r")], "seq long, tenant string, kind string")
    assert pick(predicates.audit_query(e, None), "seq") == [(1,), (3,)]
    assert pick(predicates.audit_query(e, "t", 2), "seq") == [(2,)]
    assert pick(predicates.audit_query(e, None, 2, "r", 1), "seq") == [(3,)]


def test_scrub_verdicts(spark):
    p = spark.createDataFrame([(c, [1, 2, 3]) for c in "abcd"], "chunk string, peers array<long>")
    here = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("c", 3)], "chunk string, peer long")
    h = joins.replica_health(p, here, 3, 2)
    assert pick(h, "chunk", "verdict") == [("a", "Healthy"), ("b", "Repair"), ("c", "Critical"), ("d", "Lost")]
    assert pick(joins.repair_plan(h), "chunk", "from", "to") == [("b", 2, 1), ("c", 3, 1)]


def test_orphans_by_age(spark):
    local = spark.createDataFrame([(1, 0), (2, joins.DAY_MS - 1), (3, joins.DAY_MS), (4, joins.DAY_MS)], "ref long, age_ms long")
    meta = spark.createDataFrame([(1, False), (4, True)], "ref long, tombstoned boolean")
    assert pick(joins.orphan_scrub(local, meta), "ref", "decision") == [(1, "Keep"), (2, "KeepYoung"), (3, "Delete"), (4, "Delete")]


LOCK = "file long, owner string, write_lock boolean, lock_id long, off long, len long, acquired_ms long"


def test_lock_conflicts_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice("ab"), rng.random() < 0.5, i, rng.randrange(400), rng.choice([0, 1, 5, 64, 200]), rng.randrange(100)) for i in range(120)]
    a, b = rows[:60], rows[60:]
    end = lambda r: 2**62 if r[5] == 0 else r[4] + r[5]
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] != y[1] and (x[2] or y[2]) and x[4] < end(y) and y[4] < end(x) and 100 - y[6] <= 50}
    got = joins.lock_conflicts(spark.createDataFrame(a, LOCK), spark.createDataFrame(b, LOCK), 100, 50)
    found = [(r.request, r.holder) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_as_of_reads(spark):
    d = deltas(spark, [(1, 7, "Delete"), (2, 7, "Create"), (5, 7, "Update"), (8, 7, "Delete")])
    probes = spark.createDataFrame([(i, 7, t) for i, t in enumerate((10, 20, 49, 50, 80, 99))] + [(9, 8, 50)], "probe long, key long, at_ms long")
    got = joins.version_at_time(probes, versions.version_chain(d))
    assert pick(got, "probe", "version") == [(0, None), (1, 1), (2, 1), (3, 2), (4, None), (5, None), (9, None)]


def test_as_of_reads_take_the_last_appended(spark):
    chain = spark.createDataFrame([(1, 1, 500, False, 10), (1, 2, 100, False, 11), (1, 3, 900, True, 12)], "key long, version long, at_ms long, deleted boolean, seq long")
    probes = spark.createDataFrame([(i, 1, t) for i, t in enumerate((99, 100, 600, 900))], "probe long, key long, at_ms long")
    assert pick(joins.version_at_time(probes, chain), "probe", "version") == [(0, None), (1, 2), (2, 2), (3, None)]


def test_long_locks(spark):
    rows = [(0, "a", True, 1, 0, 1 << 40, 0), (0, "b", True, 2, (1 << 40) - 1, 1, 0), (0, "c", False, 3, 1 << 40, 7, 0), (0, "d", True, 4, 5, 0, 0), (0, "e", True, 5, (1 << 61), 1 << 60, 0)]
    locks = spark.createDataFrame(rows, LOCK)
    got = {(r.request, r.holder) for r in joins.lock_conflicts(locks, locks, 100, 1000).collect()}
    assert got == {(1, 2), (2, 1), (1, 4), (4, 1), (2, 4), (4, 2), (3, 4), (4, 3), (4, 5), (5, 4)}


def test_chunks_without_peers_are_lost(spark):
    placement = spark.createDataFrame([(1, [1, 2]), (2, []), (3, [3])], "chunk long, peers array<long>")
    presence = spark.createDataFrame([(1, 1), (1, 2)], "chunk long, peer long")
    assert pick(joins.replica_health(placement, presence, 2, 1), "chunk", "width", "verdict") == [(1, 2, "Healthy"), (2, 0, "Lost"), (3, 1, "Lost")]


def test_rebalancing_moves_whole_chunks_one_to_one(spark):
    rows = [(0, 1, 1000, 950, [11, 12, 13, 14, 15]), (0, 2, 1000, 900, []), (0, 3, 1000, 800, [31, 32, 33, 34]), (0, 4, 1000, 100, []), (0, 5, 1000, 600, [51]), (1, 6, 10, 10, [61]), (1, 7, 0, 0, [])]
    devices = spark.createDataFrame(rows, "pool long, device long, capacity long, used long, chunks array<long>")
    got = sorted(tuple(r) for r in placement.rebalance_plan(devices, 60).collect())
    # 350 over 190 a chunk: two; 200 over 200 a chunk: one; a target without room ends its source's turn.
    assert got == [(0, 1, 4, [11, 12], 380), (0, 3, 5, [31], 200)]


def test_opt_out_goes_one_way(spark):
    states = ("enabled", "draining", "disabled")
    rows = spark.createDataFrame([(a, b, x) for a in states for b in states for x in (False, True)], "a string, b string, x boolean")
    allowed = {tuple(r)[:3] for r in rows.withColumn("ok", policy.opt_out_transition(F.col("a"), F.col("b"), F.col("x"))).filter("ok").collect()}
    assert allowed == {("enabled", "draining", False), ("enabled", "draining", True), ("draining", "disabled", False), ("draining", "disabled", True), ("enabled", "disabled", True)}


def test_unknown_names_filter_nothing(spark):
    e = spark.createDataFrame([(1, 10, "error", "node"), (2, 10, "info", "raft"), (3, 10, "info", "other")], "id long, at_ms long, severity string, category string")
    ids = lambda *x: [r.id for r in predicates.event_api(e, 10, 1, *x).collect()]
    assert [ids("error"), ids(None, "raft"), ids("loud", "other"), ids("info", "node")] == [[1], [2], [3, 2, 1], []]


def test_objects_are_bytes(spark):
    body = "aü😀" * 5
    o = spark.createDataFrame([(1, 0, body), (1, 1, ""), (1, 2, "xy"), (2, 0, "")], "id long, pos long, body string")
    whole = (body + "xy").encode()
    for at, n in ((0, 3), (33, 4), (36, 10), (40, 5), (2, 100)):
        got = {r.id: (bytes(r.data), r.eof, r.size) for r in chunks.object_read(o, at, n).collect()}
        assert got == {1: (whole[at : at + n], at + n >= len(whole), len(whole)), 2: (b"", True, 0)}
    pieces = chunks.object_write_split(spark.createDataFrame([(1, body), (2, "")], "id long, body string"), 4).collect()
    assert [r["size"] for r in sorted(pieces, key=lambda r: (r.id, r.pos))] == [4] * 8 + [3, 0]
    ranges = spark.createDataFrame([("bytes=99999999999999999999-",), (" bytes=1-2 ",)], "s string")
    assert [tuple(r) for r in ranges.select(*(c.alias(k) for k, c in chunks.http_range(F.col("s"), F.lit(10).cast("long")).items())).collect()] == [("malformed", None, None), ("ok", 1, 2)]


def test_inline_keys_mix_all_eight_bytes(spark):
    key, seq = bytes(range(32)), 0x0102030405060708
    row = spark.range(1).select(scalar.inline_key(F.lit(key.hex()), F.lit(seq)).alias("k")).first()
    assert row.k == (key[:24] + bytes(a ^ b for a, b in zip(key[24:], seq.to_bytes(8, "little"), strict=True))).hex()


def test_whole_number_rules_on_large_sizes(spark):
    tb = 1 << 50
    one = spark.range(1).select(aggregates.pool_state(F.lit(95 * tb), F.lit(100 * tb)).alias("a"), aggregates.pool_state(F.lit(95 * tb - 1), F.lit(100 * tb)).alias("b"), aggregates.pool_state(F.lit(5), F.lit(0)).alias("c")).first()
    assert tuple(one) == ("readonly", "critical", "ok")
    soft = spark.range(1).select(*aggregates.metadata_budget(F.lit((1 << 60) + 99), F.lit(7), 60, 80)).first()
    assert tuple(soft) == (((1 << 60) + 99) * 60 // 100, ((1 << 60) + 99) * 80 // 100, ((1 << 60) + 99) * 60 // 100 - 7)


def test_refcounts(spark):
    c = spark.createDataFrame([("a", 1, 1), ("a", 2, -1), ("a", 3, -1), ("a", 4, 1)], "chunk string, at long, delta long")
    assert pick(aggregates.refcount_history(c), "at", "count", "tombstoned") == [(1, 1, False), (2, 0, True), (3, 0, True), (4, 1, False)]


def simulated_polls(rows, start, polls, threshold):
    """The hydrator poll by poll, as it would run: (position, stuck at, tries, outcome by seq)."""
    position, stuck, spaces, alive, out = start, None, set(), set(), {}
    for _ in range(polls):
        for seq, op, key, ns in rows:
            if seq <= position:
                continue
            missing = op == "Create" and key not in alive and ns not in spaces or op == "Update" and key not in alive
            if missing:
                tries = (stuck[1] if stuck and stuck[0] == seq else 0) + 1
                if tries < threshold:
                    stuck = (seq, tries)
                    out[seq] = "TransientSkip"
                    break
                stuck, out[seq], position = None, "PermanentSkip", seq
                continue
            if op == "NamespaceCreate":
                spaces.add(ns)
            if op == "Create":
                alive.add(key)
            if op == "Delete":
                alive.discard(key)
            stuck, out[seq], position = None, "Applied", seq
    return position, stuck, out


@pytest.mark.parametrize(("polls", "threshold"), [(1, 3), (4, 3), (9, 2), (30, 4)])
def test_polls_of_the_hydrator(spark, polls, threshold):
    rng = random.Random(polls)
    rows = [(i, rng.choice(["Create", "Update", "Update", "Delete", "NamespaceCreate"]), rng.randrange(4), rng.randrange(3)) for i in range(1, 60)]
    position, stuck, out = simulated_polls(rows, 0, polls, threshold)
    d = spark.createDataFrame([(0, *r) for r in rows] + [(1, 5, "Delete", 1, 1)], "shard long, seq long, op string, key long, ns long")
    cursors = spark.createDataFrame([(0, 0), (1, 2), (2, 7)], "shard long, position long")
    found = chunks.hydrate_poll(d, cursors, polls, threshold)
    got = {r.seq: r.outcome for r in found.filter("shard = 0").collect()}
    assert got == {s: out.get(s, "Pending") for s, *_ in rows}
    ends = {r.shard: tuple(r)[1:] for r in chunks.hydrate_cursor(found, cursors).collect()}
    assert ends == {0: (position, *(stuck or (None, None)), False), 1: (2, None, None, True), 2: (7, None, None, False)}


def test_chunk_states(spark):
    rows = [("t", 1, 1, "increment"), ("t", 1, 2, "create"), ("t", 1, 3, "decrement"), ("t", 1, 4, "decrement"), ("t", 1, 5, "create"), ("t", 2, 6, "create"), ("t", 2, 7, "decrement"), ("t", 2, 8, "increment"), ("u", 1, 9, "decrement")]
    c = spark.createDataFrame([(*r, [7], r[2] * 10) for r in rows], "tenant string, chunk long, at long, command string, placement array<int>, original_len long")
    assert pick(chunks.chunk_states(c), "tenant", "chunk", "refcount", "tombstoned", "created_at", "original_len") == [("t", 1, 0, True, 2, 20), ("t", 2, 1, False, 6, 60)]


def test_small_objects(spark):
    rows = [("k", 1, "get", None), ("k", 2, "put", "a"), ("k", 3, "put", "bb"), ("k", 4, "get", None), ("k", 5, "delete", None), ("k", 6, "contains", None), ("k", 7, "delete", None), ("m", 1, "put", "xyz")]
    ops = spark.createDataFrame(rows, "key string, at long, op string, value string")
    assert [(r.key, r.at, r.flag, r.value) for r in chunks.small_object_log(ops).orderBy("key", "at").collect()] == [("k", 1, False, None), ("k", 2, True, None), ("k", 3, False, None), ("k", 4, True, "bb"), ("k", 5, True, None), ("k", 6, False, None), ("k", 7, False, None), ("m", 1, True, None)]
    assert tuple(chunks.small_object_len(ops).first()) == (1, 3)


def test_folds(spark):
    w = spark.createDataFrame([("k", t, n) for t, n in ((0, 5), (4, 5), (11, 0), (30, 0), (31, 200), (32, 1))], "k string, at long, size long")
    assert [r.bytes for r in sequences.write_batches(w, "k", "at", "size", 100, 10).orderBy("batch").collect()] == [10, 0, 200, 1]
    s = spark.createDataFrame([("d", i, x) for i, x in enumerate(("Online", "Decommissioned", "Offline", "Draining", "Online", "Draining", "Draining", "Decommissioned", "Online"))], "device string, at long, state string")
    assert pick(sequences.device_transitions(s), "at", "before", "allowed") == [(1, "Online", False), (2, "Online", True), (3, "Offline", False), (4, "Offline", True), (5, "Online", True), (6, "Draining", False), (7, "Draining", True), (8, "Decommissioned", False)]
    c = spark.createDataFrame([("o", i, x) for i, x in enumerate((False, True, True, True, False, True))], "owner string, at long, declares boolean")
    assert pick(sequences.workflow_slots(c, 2), "at", "admitted", "active") == [(0, False, 0), (1, True, 1), (2, True, 2), (3, False, 2), (4, True, 1), (5, True, 2)]


def test_clocks_carry(spark):
    clock = lambda p, n: F.struct(F.lit(p).cast("long").alias("physical"), F.lit(n).cast("long").alias("logical"))
    merge = lambda a, b, now: spark.range(1).select(sequences.hlc_merge(clock(*a), clock(*b), F.lit(now).cast("long")).alias("m")).first().m
    top, full = 2**63 - 1, 2**32 - 1
    assert tuple(merge((5, full), (5, 3), 1)) == (6, 0) and tuple(merge((5, 1), (4, full), 1)) == (5, 2)
    assert merge((top, full), (0, 0), 0) is None and tuple(merge((5, full), (4, 0), 9)) == (9, 0)


def test_fragments_by_definition(spark):
    import hashlib

    ids = [hashlib.sha256(bytes([i])).digest() for i in range(40)]
    frame = spark.createDataFrame([(i, x.hex()) for i, x in enumerate(ids)], "chunk long, chunk_id string")
    devices = [bytes([i]) * 16 for i in (9, 4, 7, 1, 8, 2, 3)]

    def score(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    want, place = [], []
    for i, x in enumerate(ids):
        left, rest = list(range(7)), [10, 20, 30, 40, 50, 60, 70]
        seed = int.from_bytes(x[:8], "little") * 2654435761
        for f in range(6):
            best = max(left, key=lambda d: (score(x + f.to_bytes(4, "little") + devices[d]), -d))
            left.remove(best)
            want.append((i, f, best, f >= 4))
            place.append((i, f, rest.pop((seed + f) % 2**64 % len(rest))))
    assert pick(placement.crush_assign(frame, devices, 4, 2), "chunk", "fragment", "device", "parity") == want
    assert pick(placement.place_fragments(frame, [10, 20, 30, 40, 50, 60, 70], 6), "chunk", "fragment", "device") == place
    assert placement.place_fragments(frame, [1, 2], 6).count() == 0
    with pytest.raises(ValueError, match="devices"):
        placement.crush_assign(frame, devices[:5], 4, 2)


def test_widest_ranges_split_first(spark):
    rows = placement.ratio_floor_split(spark, placement.shard_ranges(spark, 3, 4), 4, 1.5).collect()
    assert len(rows) == 6 and [r.range_start for r in rows][1:] == [r.range_end for r in rows][:-1]
    assert sorted(r.shard for r in rows) == list(range(6)) and rows[0].range_start == "0" * 64 and rows[-1].range_end == "f" * 64
    assert len(placement.ratio_floor_split(spark, placement.shard_ranges(spark, 3, 4), 2, 1.5).collect()) == 3


def test_compression_is_raw_and_bounded(spark):
    import zlib

    z = coding.compress_pad(64)
    row = spark.createDataFrame([(bytearray(b"abc" * 500),), (bytearray(b""),)], "p binary").select("p", z("p").alias("z")).select("p", "z", coding.unpad_decompress(2000)("z").alias("back"), coding.unpad_decompress(100)("z").alias("short")).collect()
    assert all(len(r.z) % 64 == 0 and bytes(r.back) == bytes(r.p) and zlib.decompressobj(-15).decompress(bytes(r.z)) == bytes(r.p) for r in row)
    assert [r.short is None for r in row] == [True, False]
    with pytest.raises(ValueError, match="positive"):
        coding.compress_pad(0)


def test_nearest_rank(spark):
    s = spark.createDataFrame([("x", v) for v in (5, 1, 1, 9, 7)] + [("y", 3)], "k string, v long")
    assert pick(aggregates.latency_percentiles(s, "k", "v"), "k", "n", "p50", "p95", "p99") == [("x", 5, 5, 9, 9), ("y", 1, 3, 3, 3)]


def test_metrics_text(spark):
    text = 'raft 42\n# c\n\nbytes 7\nreq{a="1"} 3\nreq{a="2"} 4\nraft 43\nbad x\n'
    t = spark.createDataFrame([(1, text), (2, "")], "node long, text string")
    got = {tuple(r) for r in aggregates.metrics_text_scan(t, {"raft": "raft", "bytes": "bytes"}, {"req": "req"}).collect()}
    assert got == {(1, 43, 7, 7), (2, 0, 0, 0)}


def test_sequential_runs_and_batches(spark):
    r = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 10), (1, 3, 20, 5), (1, 4, 40, 5), (1, 5, 45, 0), (1, 6, 45, 5)], "file long, at long, off long, len long")
    assert pick(sequences.sequential_reads(r), "at", "run", "prefetch_off") == [(1, 1, None), (2, 2, None), (3, 3, 25), (4, 1, None), (5, 2, None), (6, 1, None)]
    w = spark.createDataFrame([("k", i, n) for i, n in enumerate((40, 40, 40, 100, 5))], "k string, at long, size long")
    assert [r.bytes for r in sequences.write_batches(w, "k", "at", "size", 100).orderBy("batch").collect()] == [120, 100, 5]
    e = spark.createDataFrame([("k", i, n) for i, n in enumerate((100, 50, 7))], "k string, at long, v long")
    assert sequences.latency_ema(e, "k", "at", "v").first().ema == (7 + 4 * ((50 + 400) // 5)) // 5


def test_clock_is_strictly_monotone(spark):
    rng = random.Random(2)
    rows = [(n, i, rng.randrange(20)) for n in range(3) for i in range(60)]
    out = sequences.hlc_tick(spark.createDataFrame(rows, "node long, at long, physical long"))
    for n in range(3):
        stamps = [(r.physical, r.logical) for r in out.filter(F.col("node") == n).orderBy("at").collect()]
        assert all(a < b for a, b in zip(stamps, stamps[1:], strict=False))


def test_rendezvous_is_stable(spark):
    c = spark.range(300).select(F.col("id").alias("chunk"))
    top = lambda nodes: {r.chunk: r.node for r in placement.rendezvous_topk(c, nodes, 1).collect()}
    before, after = top([1, 2, 3, 4, 5]), top([1, 2, 4, 5])
    assert all(before[k] == after[k] for k in before if before[k] != 3)


def test_key_ranges_are_exact(spark):
    r = placement.shard_ranges(spark, 7, 3).orderBy("shard").collect()
    assert r[0].range_start == "0" * 64 and r[-1].range_end == "f" * 64
    assert [x.range_end for x in r[:-1]] == [x.range_start for x in r[1:]] and int(r[3].range_start, 16) == 2**256 * 3 // 7
    m = spark.createDataFrame([("0" * 64, format(2, "064x")), ("0" * 64, format(1, "064x"))], "a string, b string").select(placement.midpoint("a", "b").alias("m")).collect()
    assert [x.m for x in m] == [format(1, "064x"), None]


def test_split_and_merge_keep_every_delta(spark):
    d = deltas(spark, [(i, i % 9, "Update") for i in range(40)])
    split = placement.split_apply(d, 0, 1, 5)
    assert pick(split, "seq") == pick(d, "seq") and split.filter("shard = 1").agg(F.min("key")).first()[0] == 5
    merged = placement.merge_copy(split.filter("shard = 0"), split.filter("shard = 1"))
    assert sorted(r.new_seq for r in merged.collect()) == list(range(1, 41))


def test_merge_ratio(spark):
    r = spark.createDataFrame([(5, 3, 1.5), (6, 3, 1.5), (7, 4, 1.5), (5, 0, 1.5)], "s long, n long, f double")
    assert [x.ok for x in r.select(placement.merge_allowed(F.col("s"), F.col("n"), F.col("f")).alias("ok")).collect()] == [False, True, True, False]


def test_best_fit_against_all_pairs(spark):
    rng = random.Random(7)
    needs, free = [(0, i, rng.randrange(50)) for i in range(40)], [(0, 100 + i, rng.randrange(40)) for i in range(20)]
    got = placement.best_fit(spark.createDataFrame(needs, "volume long, need long, bytes long"), spark.createDataFrame(free, "volume long, extent long, bytes long"))
    want = {i: min(((b, e) for _, e, b in free if b >= n), default=(None, None))[1] for _, i, n in needs}
    assert {r.need: r.extent for r in got.collect()} == want


def test_best_fit_with_nulls_repeats_and_volumes(spark):
    rng = random.Random(8)
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    needs = [(some(3), rng.randrange(60), some(50)) for _ in range(120)]
    free = [(some(3), some(100), some(48)) for _ in range(60)]
    got = placement.best_fit(spark.createDataFrame(needs, "volume long, need long, bytes long"), spark.createDataFrame(free, "volume long, extent long, bytes long"))
    want = {}
    for v, i, n in needs:
        fits = [(b, e) for w, e, b in free if None not in (v, n, b, e) and v == w and b >= n]
        want[v, i] = min([*fits, want.get((v, i), (1000, None))])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*k, e)) for k, (_, e) in want.items())


def test_best_fit_never_sums_a_frame_anew(spark):
    rows = spark.range(10).select(F.lit(0).alias("volume"), F.col("id").alias("need"), F.col("id").alias("extent"), F.col("id").alias("bytes"))
    plan = placement.best_fit(rows.drop("extent"), rows.drop("need"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan


def test_policy(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first().x
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert v(policy.effective_tags(a("b", "a"), a("a", "c"))) == ["b", "a", "c"]
    assert v(policy.effective_profiles(a("x", "y"), a("y", "x"), a("z", "y", "x"))) == ["y", "x"]
    assert [v(policy.effective_staleness(F.lit(n), t)) for n, t in ((1000, a("HIPAA")), (5000, a("HIPAA")), (500, a()))] == [2000, 5000, 500]
    assert [v(policy.clamp_mode(F.lit("pinned"), t)) for t in (a("pinned"), a("organic", "x"), a("x"), a())] == ["pinned", "organic", "x", "bypass"]


def test_identifiers(spark):
    name = "bucket-ü"
    row = spark.createDataFrame([(name,)], "n string").select(scalar.uuid5(F.lit(scalar.DNS_NAMESPACE), F.col("n")).alias("u"), scalar.hmac_sha256(b"Jefe", F.lit("what do ya want for nothing?")).alias("h"), scalar.log2_bucket(F.lit(8)).alias("l")).first()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert row.h == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843" and row.l == 4
    with pytest.raises(ValueError, match="key"):
        scalar.hmac_sha256(b"", F.lit("x"))


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 1000])
def test_any_four_of_six_fragments_suffice(size):
    from itertools import combinations

    payload = np.random.default_rng(size).bytes(size)
    f = coding.encode(payload, 4, 2)
    for keep in combinations(range(6), 4):
        assert coding.decode([f[i] if i in keep else None for i in range(6)], 4, 2, size) == payload
    assert coding.decode([f[0], f[1], f[2], None, None, None], 4, 2, size) is None


def test_byte_ranges(spark):
    specs = ["bytes=0-0", "bytes=5-", "bytes=-3", "bytes=-99", "bytes=10-", "bytes=4-2", "bytes=0-99", "bytes=", "x", "bytes=1-2,4-5"]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    got = [tuple(r) for r in df.select(*(c.alias(k) for k, c in chunks.http_range(F.col("s"), F.lit(10).cast("long")).items())).collect()]
    assert got == [("ok", 0, 0), ("ok", 5, 9), ("ok", 7, 9), ("ok", 0, 9), ("unsatisfiable", None, None), ("unsatisfiable", None, None), ("ok", 0, 9), ("malformed", None, None), ("malformed", None, None), ("unsatisfiable", None, None)]


def test_hydration(spark):
    rows = [(1, "u", "Update", 5), (2, "a", "Create", 1), (3, "a", "Create", 9), (4, "a", "Update", 1), (5, "a", "Update", 2), (6, "b", "Create", 1), (7, "b", "Delete", 0), (8, "b", "Update", 3), (9, "b", "Create", 4)]
    d = spark.createDataFrame(rows, "seq long, key string, op string, value long")
    assert pick(chunks.hydrate(d), "key", "value", "version", "seq") == [("a", 2, 2, 5), ("b", 4, 1, 9)]
    assert [r.seq for r in chunks.hydrate_outcomes(d).filter("outcome = 'PermanentSkip'").orderBy("seq").collect()] == [1, 8]


def test_view_survives_a_restart(spark, tmp_path):
    def project(df):
        return df.select("key", "seq", "value")

    log_dir, schema = str(tmp_path / "log"), "key long, seq long, value string"
    v = view.View(spark, f"file://{tmp_path}/view", project)
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")], schema).write.parquet(log_dir)
    v.poll(log_dir, schema)
    spark.createDataFrame([(2, 4, "d"), (3, 5, "e")], schema).write.mode("append").parquet(log_dir)
    again = view.View(spark, f"file://{tmp_path}/view", project)  # a new process goes on at the cursor
    again.poll(log_dir, schema)
    want = [(1, "c"), (2, "d"), (3, "e")]
    assert pick(again.read(), "key", "value") == want
    again.discard()
    again.poll(log_dir, schema)
    assert pick(again.read(), "key", "value") == want


def test_poll_takes_the_smallest_position(spark):
    d = deltas(spark, [(s, 0, "Update") for s in range(4991, 5001)])
    cursor = lambda n: spark.createDataFrame([("v", 0, n)], "view string, shard long, position long")
    assert view.view_poll(d, cursor(4990)).first().position == 5000
    assert view.view_poll(d, cursor(4500)).first().position == 5000
    both = cursor(4990).unionByName(spark.createDataFrame([("v", 1, 7)], "view string, shard long, position long"))
    assert view.view_poll(d, both).first().position == 7
    # A shard whose next delta lies beyond the batch holds the view too.
    far = deltas(spark, [(5000, 0, "Update")]).unionByName(spark.createDataFrame([(s, 1, 0, "Update", False, 0, 5) for s in range(6, 21)], DELTA))
    cursors = spark.createDataFrame([("v", 0, 4), ("v", 1, 5)], "view string, shard long, position long")
    assert view.view_poll(far, cursors).first().position == 4


def test_live_token_bucket_matches_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, 1000 + i * 130) for i in range(60)]
    schema = "owner string, id long, at_ms long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = view.live_token_bucket(spark.readStream.schema(schema).parquet(str(tmp_path / "calls")), 3)
    q = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sequences.token_bucket(spark.createDataFrame(rows, schema), 3)
    assert pick(spark.table("admitted"), "id", "admitted") == pick(batch, "id", "admitted")


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
