"""Removal of repeated byte strings, by sorting fingerprints of windows; a difference cover thins them out.

A byte is removed if a string of ``LENGTH`` bytes over it starts earlier too.
Only the equality of suffixes up to that length matters, so a suffix is a window
and fingerprints stand for its bytes: nothing is sorted by its bytes, and no tie
is resolved by the ranks of a cover sample.

1. Blocks.  Texts lie in order of document id in blocks of about
   ``BLOCK_BYTES``; one exchange moves every text once into a table that later
   steps join on its bucket, without moving text again.
2. Cover sample.  For the difference cover D modulo v, any two positions have an
   offset below v that brings both into the sample (positions p with p mod v
   in D).  The sample's strings of ``LENGTH - v + 1`` bytes are ranked: sorted by
   fingerprint, bucket by bucket, a rank being *repeated* or *single*.
3. Suffix buckets.  A window can only stand twice if a sampled string inside it
   is repeated, so the sample's ranks decide which suffixes are built at all:
   no others are sorted.  Those are sorted one bucket at a time, in ``ROUNDS``
   rounds, so that what is on disk and in memory is a part of the suffixes.
4. Every block marks, from the sorted buckets, the windows that stand in an
   earlier block or earlier in itself, and cuts them out.

Suffixes travel as sorted arrays of fingerprints per block and bucket, and the
answer comes back as one bit each; a suffix that all documents share is one
entry per block.  Sample strings may share a fingerprint by chance (that only
builds a few suffixes too many); windows are told apart by two independent
fingerprints, 128 bits in all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import FREE_SHUFFLE, Scratch, settings

LENGTH = 100
#: A perfect difference cover.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 2_000_000
ROUNDS = 4
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SECOND = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_JOIN_ON_BUCKETS = {"spark__sql__requireAllClusterKeysForCoPartition": "false"}


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand; symbols of the byte values."""

    def __init__(self, multiplier: int, label: bytes) -> None:
        self.multiplier = multiplier
        self.up = self.down = np.ones(1, np.uint64)
        self.symbol = np.frombuffer(hashlib.shake_256(label).digest(256 * 8), np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(self.multiplier, -1, 1 << 64)
            for name, base in (("up", self.multiplier), ("down", inverse)):
                steps = np.full(n, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers(_MULTIPLIER, b"suffix symbols")
_powers2 = _Powers(_SECOND, b"second suffix symbols")
_SEGMENT = 1 << 15  # its tables stay in a core's cache


def window_hashes(data: np.ndarray, length: int, at: np.ndarray | None = None, powers: _Powers = _powers) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` bytes at positions ``at`` (all by default).

    Differences of prefix sums of symbol * multiplier**position, brought back
    to position zero; computed in segments, so a long block needs no long table.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n if at is None else len(at), np.uint64)
    starts = range(0, n, _SEGMENT)
    cuts = [*starts, n] if at is None else np.searchsorted(at, [*starts, n]).tolist()
    for lo, i, j in zip(starts, cuts, cuts[1:], strict=False):
        if i == j:
            continue
        part = data[lo : min(n, lo + _SEGMENT) + length - 1]
        up, down = powers.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(powers.symbol[part] * up, out=sums[1:])
        own = out[i:j]
        if at is None or 8 * (j - i) > len(part):  # most of them are wanted: no three gathers
            every = sums[length:] - sums[:-length]
            every *= down[: len(every)]
            own[:] = every if at is None else every[at[i:j] - lo]
        else:
            p = at[i:j] - lo
            own[:] = (sums[p + length] - sums[p]) * down[p]
        own ^= own >> np.uint64(32)
        own *= np.uint64(0xD6E8FEB86659FD93)
        own ^= own >> np.uint64(32)
    return out


def window_pairs(data: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Both fingerprints of the strings at positions ``at``, a row each."""
    return np.stack([window_hashes(data, length, at), window_hashes(data, length, at, _powers2)], axis=1)


def _rising(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The stable order of keys (words or rows of words, the first counts most), where it starts a new key, and the words in that order.

    The leading bits of the first word and the row's number are sorted as one
    word; of keys alike in those bits, only such as differ are sorted again.
    """
    rows = keys if keys.ndim == 2 else keys[:, None]
    n = len(rows)
    if n < 2:
        return np.arange(n), np.ones(n, bool), list(rows.T)
    low = np.uint64((n - 1).bit_length())
    number = (np.uint64(1) << low) - np.uint64(1)
    packed = rows[:, 0] - rows[:, 0].min()
    packed <<= np.uint64(min(63, 64 - int(packed.max()).bit_length()))
    packed &= ~number
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & number).astype(np.int64)
    ahead = np.ones(n, bool)
    ahead[1:] = (packed[1:] ^ packed[:-1]) > number

    def arranged() -> tuple[list[np.ndarray], np.ndarray]:
        words, first = [word[order] for word in rows.T], np.ones(n, bool)
        first[1:] = words[0][1:] != words[0][:-1]
        for word in words[1:]:
            first[1:] |= word[1:] != word[:-1]
        return words, first

    words, first = arranged()
    mixed = first & ~ahead
    if mixed.any():
        run = np.cumsum(ahead) - 1
        dirty = np.zeros(run[-1] + 1, bool)
        dirty[run[mixed]] = True
        at = np.flatnonzero(dirty[run])
        own = order[at]
        order[at] = own[np.lexsort((own, *rows[own].T[::-1], run[at]))]
        words, first = arranged()
    return order, first, words


def _inside(sizes: np.ndarray, length: int) -> np.ndarray:
    """Where a string of ``length`` bytes may start without leaving its document."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    ok = np.zeros(total + 1, np.int8)
    fits = sizes >= length
    np.add.at(ok, (ends - sizes)[fits], 1)
    np.add.at(ok, (ends - length + 1)[fits], -1)
    return np.cumsum(ok[:-1]).astype(bool)


def sample_positions(sizes: np.ndarray, length: int) -> np.ndarray:
    """Positions of the cover sample whose string stays inside its document."""
    total = int(sizes.sum())
    starts = np.arange(0, total, PERIOD)[:, None] + np.array(COVER)[None, :]
    starts = starts.ravel()
    starts = starts[starts < total]
    return starts[_inside(sizes, length)[starts]]


def _bounds(n: int) -> np.ndarray:
    """The first key of each of ``n`` buckets but the first: equal ranges of a key's upper half."""
    b = np.arange(1, n, dtype=np.uint64) << np.uint64(32)
    return (b + np.uint64(n - 1)) // np.uint64(n) << np.uint64(32)


def _distinct(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order (which is bucket order), the bounds of buckets among them, the order of all keys and where it starts a new one."""
    order, first, words = _rising(keys)
    words = [word[first] for word in words]
    bounds = np.concatenate([[0], np.searchsorted(words[0], _bounds(n)), [len(words[0])]])
    return words[0] if keys.ndim == 1 else np.stack(words, axis=1), bounds, order, first


def distinct_by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order (which is bucket order), the bounds of buckets among them, the distinct index of each key.

    A key is a word or a row of words; its first word chooses the bucket.
    """
    values, bounds, order, first = _distinct(keys, n)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return values, bounds, inverse


def make_blocks(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The table of blocks (part, block, ids, sizes, data) and its bytes; the catalog holds it only until it is resolved."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_data"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    facts = rows.agg(F.percentile_approx("_id", [i / (4 * n) for i in range(1, 4 * n)], 10_000).alias("cuts"), F.sum(F.octet_length("_data")).alias("bytes")).first()
    bounds = np.unique(np.array(facts["cuts"] or [], dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(bounds))  # null ids come last
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(dtype=np.int64), side="left")
        return pd.Series(out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids, texts, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())],
                names=["part", "block", "ids", "sizes", "data"],
            )

        for batch in batches:
            for p, i, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if texts and (p != part or size >= block_bytes):
                    yield flush()
                    block = block + 1 if p == part else 0
                    ids, texts, size = [], [], 0
                part = p
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield flush()

    dealt = rows.withColumn("part", part_of("_id")).select("part", "_id", "_data").repartition(n, "part").sortWithinPartitions("part", F.asc_nulls_last("_id"), "_data")
    blocks = dealt.mapInArrow(gather, "part int, block int, ids array<long>, sizes array<long>, data binary")
    name = f"deltaloom_blocks_{uuid.uuid4().hex}"
    try:
        with settings(spark, **FREE_SHUFFLE):
            blocks.write.bucketBy(n, "part").option("path", f"{scratch.root}/blocks").option("compression", "zstd").saveAsTable(name)
        return spark.table(name), facts["bytes"] or 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay until the scratch folder goes


_KEYS = "bucket int, part int, block int, keys binary"
_MARKS = "part int, block int, bucket int, marks binary"


def _emit_keys(values: np.ndarray, bounds: np.ndarray, part: int, block: int, width: int, buckets: range) -> pa.RecordBatch:
    full = [b for b in buckets if bounds[b] < bounds[b + 1]]
    low = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), 8 * values[0].size)[:, :width] if len(values) else values
    blobs = [low[bounds[b] : bounds[b + 1]].tobytes() for b in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "part", "block", "keys"])


def _sort_buckets(keys: DataFrame, width: int, mark: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One bucket after the other: its keys are sorted and each is marked or not.

    ``mark`` sees the sorted keys' run starts; the marks go back as bits in the
    order in which the block sent its keys.
    """

    def close(bucket: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sizes = [len(k) // width for _, _, k in rows]
        wide = np.zeros((sum(sizes), 8 * -(-width // 8)), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(k for _, _, k in rows), np.uint8).reshape(-1, width)
        order, first, _ = _rising(wide.view("<u8"))  # rows come in block order
        marks = np.empty(len(order), bool)
        marks[order] = mark(first)
        bits = [np.packbits(m).tobytes() for m in np.split(marks, np.cumsum(sizes)[:-1])]
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([b for _, b, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(bits, pa.binary())], names=["part", "block", "bucket", "marks"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, p, k, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket and rows:
                    yield close(bucket, rows)
                    rows = []
                bucket = b
                rows.append((p, k, blob))
        if rows:
            yield close(bucket, rows)

    return keys.repartition(F.col("bucket")).sortWithinPartitions("bucket", "part", "block").mapInArrow(run, _MARKS)


def _repeated(first: np.ndarray) -> np.ndarray:
    """Keys that another row holds too."""
    return ~(first & np.append(first[1:], True))


def _later(first: np.ndarray) -> np.ndarray:
    """Keys that an earlier block holds."""
    return ~first


def _unpack(found: list[dict] | None, bounds: np.ndarray) -> np.ndarray:
    """Marks of distinct keys from the bits of each bucket."""
    out = np.zeros(int(bounds[-1]), bool)
    for row in found or ():
        a, b = bounds[row["bucket"]], bounds[row["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=b - a)
    return out


def _with_marks(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    per_block = marks.groupBy(F.col("part").alias("_p"), F.col("block").alias("_b")).agg(F.collect_list(F.struct("bucket", "marks")).alias("found"))
    return blocks.join(per_block, (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b")), "left").drop("_p", "_b")


def _per_block(frame: DataFrame, schema: str, work: Callable[[dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                row["sizes"] = np.array(row["sizes"], np.int64)
                row["data"] = np.frombuffer(row["data"], np.uint8)
                yield from work(row)

    return frame.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, ``spans`` (removed runs: start, end in bytes) and ``kept`` (the bytes that stay) of every document.

    Documents stand in order of id (null ids last); of rows with equal id the
    one with the smaller text counts as earlier, and of equal rows all but one
    are copies.  A null text counts as empty; matches never cross documents; an
    empty table gives an empty result; other columns are not read.
    """
    if length < PERIOD + 1:
        raise ValueError(f"length must be over {PERIOD}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    blocks, total = make_blocks(docs, scratch, id_col, text_col, block_bytes)
    sample_len = length - PERIOD + 1
    samples = max(1, total * len(COVER) // PERIOD)
    n_sample = max(1, -(-samples // bucket_keys))
    # Chance repeats among sampled strings only cost work: ten bits over the number of samples.
    width = min(8, max(4, -(-(samples.bit_length() + 10) // 8)))
    n_window = max(rounds, -(-total // (2 * bucket_keys)))
    starts = _bounds(n_window)

    def sample_of(row: dict) -> tuple[np.ndarray, ...]:
        at = sample_positions(row["sizes"], sample_len)
        keys = window_hashes(row["data"], sample_len, at) if len(at) else np.zeros(0, np.uint64)
        # The low bytes travel, the high ones choose the bucket.
        return at, *_distinct(keys, n_sample)

    def send_sample(row: dict) -> Iterator[pa.RecordBatch]:
        _, values, bounds, _, _ = sample_of(row)
        # What repeats inside the block is known here; each of its strings is sent once.
        yield _emit_keys(values, bounds, row["part"], row["block"], width, range(n_sample))

    def candidates(row: dict) -> Iterator[pa.RecordBatch]:
        at, _, bounds, order, first = sample_of(row)
        elsewhere = _unpack(row["found"], bounds)
        hit = at[order[elsewhere[np.cumsum(first) - 1] | _repeated(first)]]
        step = np.zeros(len(row["data"]) + 1, np.int64)
        np.add.at(step, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(step, hit + 1, -1)
        open_ = (np.cumsum(step[:-1]) > 0) & _inside(row["sizes"], length)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([edges.tolist()], pa.list_(pa.int32()))], names=["part", "block", "edges"])

    def windows_of(row: dict, low: int = 0, high: int = n_window) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of the windows in buckets from ``low`` and below ``high``."""
        edges = np.array(row["edges"] or [], np.int64).reshape(-1, 2)
        sizes = edges[:, 1] - edges[:, 0]
        at = np.repeat(edges[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        if not len(at):
            return at, np.zeros((0, 2), np.uint64)
        keys = window_hashes(row["data"], length, at)
        inside = np.ones(len(at), bool)
        if low > 0:
            inside &= keys >= starts[low - 1]
        if high < n_window:
            inside &= keys < starts[high - 1]
        if not inside.all():
            at, keys = at[inside], keys[inside]
        return at, np.stack([keys, window_hashes(row["data"], length, at, _powers2)], axis=1)

    def with_edges(marks: DataFrame | None = None) -> DataFrame:
        small = edges if marks is None else _with_marks(edges, marks)
        small = small.withColumnsRenamed({"part": "_p2", "block": "_b2"})
        return blocks.join(small, (F.col("part") == F.col("_p2")) & (F.col("block") == F.col("_b2"))).drop("_p2", "_b2")

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        at, keys = windows_of(row)
        _, bounds, order, first = _distinct(keys, n_window)
        elsewhere = _unpack(row["found"], bounds)
        gone = at[order[elsewhere[np.cumsum(first) - 1] | ~first]]
        step = np.zeros(len(row["data"]) + 1, np.int64)
        step[gone] += 1  # no position twice
        step[gone + length] -= 1
        covered = np.cumsum(step[:-1]) > 0
        out_spans, kept, start = [], [], 0
        for size in row["sizes"].tolist():
            own = covered[start : start + size]
            cuts = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2)
            out_spans.append([{"start": a, "end": b} for a, b in cuts.tolist()])
            kept.append(row["data"][start : start + size][~own].tobytes())
            start += size
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["sizes"].tolist(), pa.int64()), pa.array(out_spans, kind), pa.array(kept, pa.binary())], names=["_id", "n_bytes", "spans", "kept"])

    with settings(spark, **_JOIN_ON_BUCKETS, **FREE_SHUFFLE):
        keys = _per_block(blocks, _KEYS, send_sample)
        ranks = scratch.write(_sort_buckets(keys, width, _repeated), "ranks")
        edges = scratch.write(_per_block(_with_marks(blocks, ranks), "part int, block int, edges array<int>", candidates), "edges")
        scratch.drop("ranks")
        marks = None
        for k in range(rounds):
            mine = range(k * n_window // rounds, (k + 1) * n_window // rounds)

            def send_windows(row: dict, mine=mine) -> Iterator[pa.RecordBatch]:
                values, bounds, _, _ = _distinct(windows_of(row, mine.start, mine.stop)[1], n_window)
                yield _emit_keys(values, bounds, row["part"], row["block"], 16, mine)

            found = _sort_buckets(_per_block(with_edges(), _KEYS, send_windows), 16, _later)
            part = scratch.write(found, f"marks{k}")
            marks = part if marks is None else marks.unionByName(part)
        out = _per_block(with_edges(marks), "_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary", cut)
        # Written here, while the settings hold that keep the blocks in place.
        out = scratch.write(out, "kept")
    scratch.drop("blocks", "edges", *(f"marks{k}" for k in range(rounds)))
    return out.withColumnRenamed("_id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, n, k * 1000 AS base, substr(h, 2000 * k + 1, 2200) AS piece FROM (SELECT doc_id, n, h, unnest(range(0, n // 1000 + 1)) AS k FROM d)),
w AS (SELECT doc_id, base + q AS p, md5_number(substr(piece, 2 * q + 1, 200)) AS s FROM (SELECT *, unnest(range(0, 1000)) AS q FROM c) WHERE base + q <= n - 100),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE k > 1),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
