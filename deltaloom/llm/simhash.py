"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link when they differ in ``RADIUS`` bits or fewer.
Every bit position carries a non-zero vector of RADIUS + 1 bits; for each of the
2**(RADIUS + 1) - 1 non-zero vectors v, table v keeps the positions whose vector
has odd inner product with v.  The vectors of up to RADIUS differing positions
span too little to meet every v, so some table keeps none of those positions
and the two fingerprints fall into the same bucket there: no pair is missed.

Copies are folded first, so a bucket holds distinct fingerprints.  A bucket of
up to ``BUCKET`` of them is settled inside one task and gives a spanning forest
of its links, not its pairs.  Larger ones are settled without ever meeting in
one task: two fingerprints lie within four bits exactly when some word lies
within two bits of both, so each is joined to the words within two bits that
agree with the bucket's key, and equal words are folded to their smallest
fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import FREE_SHUFFLE, Scratch, settings

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 4_096
_FULL = (1 << BITS) - 1


def masks(radius: int = RADIUS) -> list[int]:
    """The covering family's bit masks, as unsigned integers."""
    top = (1 << (radius + 1)) - 1
    vector = [1 + i % top for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def _votes(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes set it."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _cut(text: str | None) -> tuple[bytes, list[int], list[int]]:
    """Words in lower case (A-Z alone) joined by blanks; where each starts and ends."""
    words = text.encode().lower().split() if text else []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), (ends - sizes).tolist(), ends.tolist()


def _shingle_hashes(joined: bytes, starts: list[int], ends: list[int], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, of the whole sequence if it is shorter."""
    digest = xxhash.xxh64_intdigest
    if len(starts) <= shingle:
        return np.array([digest(joined, SEED)] if starts else [], dtype="<u8")
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], dtype="<u8")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text; no words: zero."""
    return _votes(_shingle_hashes(*_cut(text), shingle))


def _again(hashes: np.ndarray) -> np.ndarray:
    """Hashes as if from another seed."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"_id {narrow.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints; memory in their number."""
    left, out = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            head = front.pop()
            near = np.bitwise_count((left ^ head).view(np.uint64)) <= radius
            found = left[near]
            if len(found):
                out.extend((int(head), int(f)) for f in found)
                front.extend(found)
                left = left[~near]
    return out


def _settle(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (table, key); the rows come sorted by them."""

    def emit(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in _with_end(batches):
        if batch is not None:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        else:
            cols = held
        table, key, fp = cols
        n = len(fp)
        if not n:
            continue
        new = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])]))
        stop = n if batch is None else int(new[-1])  # the last run may go on in the next batch
        held = [c[stop:].copy() for c in cols]
        starts = new[new < stop]
        sizes = np.diff(np.append(starts, stop))
        run_of = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 8, sizes)
        for shift in range(1, min(8, stop)):
            a, b = fp[: stop - shift], fp[shift:stop]
            hit = (run_of[:-shift] == run_of[shift:]) & small[:-shift] & (np.bitwise_count((a ^ b).view(np.uint64)) <= radius)
            if hit.any():
                yield emit(a[hit], b[hit])
        for k in np.flatnonzero(sizes > 8):
            links = _forest(fp[starts[k] : starts[k] + sizes[k]], radius)
            if links:
                yield emit([x for x, _ in links], [y for _, y in links])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _flips(free: list[int], depth: int) -> list[int]:
    """All words of up to ``depth`` bits set among the free positions."""
    return [_signed(sum(1 << i for i in c)) for k in range(depth + 1) for c in combinations(free, k)]


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect what fingerprints (``fp``, distinct) within ``radius`` connect."""
    family = masks(radius)
    tables = F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(family))))
    keyed = distinct.select("fp", tables.alias("_e")).select("_e.t", "_e.key", "fp")
    crowded = scratch.narrow(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("t", "key"), "crowded")
    some = crowded.limit(1).count() > 0
    rest = keyed.join(crowded, ["t", "key"], "left_anti") if some else keyed
    found = rest.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda b: _settle(b, radius), "a long, b long")
    if some:
        found = found.unionByName(_crowded_links(keyed.join(crowded, ["t", "key"], "left_semi"), family, radius))
    return found


def _crowded_links(keyed: DataFrame, family: list[int], radius: int) -> DataFrame:
    """Links through words half-way between two fingerprints of a bucket.

    Within an even radius r, d(x, y) <= r holds exactly if some word is within
    r / 2 of both; with fingerprints of one bucket it can be taken to agree
    with their key.  (An odd radius would need edges as well; it is refused.)
    """
    if radius % 2:
        raise ValueError("crowded buckets need an even radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [np.array(_flips([i for i in range(BITS) if not m >> i & 1], radius // 2), dtype=np.int64) for m in family]
        for batch in batches:
            table, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for at in range(0, len(fp), 256):
                sets = [flips[t] for t in table[at : at + 256]]
                sizes = [len(s) for s in sets]
                own = np.repeat(fp[at : at + 256], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(table[at : at + 256], sizes)), pa.array(own ^ np.concatenate(sets)), pa.array(own)], names=["t", "mid", "fp"])

    mids = keyed.select("t", "key", "fp").mapInArrow(run, "t long, mid long, fp long")
    least = mids.groupBy("t", "mid").agg(F.min("fp").alias("b"))
    return mids.join(least, ["t", "mid"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (signed long) and component_id: the smallest id that links reach, its own included.

    A null or empty text, or one of blanks alone, has fingerprint zero and is
    linked like any other.  Null ids are classed too but name no class unless
    all ids of one are null (then the class is null).  Repeated rows stay
    repeated; very long texts are read whole, their hashes counted in segments;
    an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, id_col, text_col, shingle), "marked")
    distinct = scratch.narrow(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    edges = scratch.write(links(distinct.select("fp"), scratch, radius, bucket), "links")
    roots = components(edges, scratch)
    scratch.drop("links", "crowded")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.narrow(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    classes = scratch.narrow(classes, "classes")
    scratch.drop("named", "distinct")
    return marked.join(classes, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


COPY_SHINGLE = 5
#: Copies share at least this part of their distinct shingles, as a fraction.
COPY_LIKENESS = (4, 5)
#: At similarity 0.8 a pair misses all bands with a chance of (1 - 0.8**5)**40 = 1.3e-7, below 1e-9 from 0.84 on.
COPY_BANDS = 40
COPY_ROWS = 5
#: Of four bits of each minimum, a pair at 0.8 differs in 37.5 of 200 on average; in more than this with a chance of 1e-8.
SKETCH_RADIUS = 72
SKETCH = tuple(f"s{i}" for i in range(-(-COPY_BANDS * COPY_ROWS * 4 // 64)))
_NIBBLES = 0x1111111111111111
#: Rows of the Arrow batches that hold texts or shingle sets.
TEXT_ROWS = "256"
#: Bytes of the sets of a bucket's part that one task holds; rows and shingles of the blocks that it compares at once.
PART_BYTES = 8 << 20
BLOCK_ROWS = 128
BLOCK_SHINGLES = 100_000
_draw = np.random.default_rng(SEED)
_XOR, _ODD = (_draw.integers(0, 1 << 64, COPY_BANDS * COPY_ROWS, np.uint64) | np.uint64(k) for k in (0, 1))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the band functions."""
    least = np.full(len(_XOR), _FULL, np.uint64)
    for at in range(0, len(hashes), 256):
        part = hashes[None, at : at + 256] ^ _XOR[:, None]
        part *= _ODD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    """One word for each band of minima."""
    keys = np.arange(COPY_BANDS, dtype=np.uint64)
    for row in least.reshape(COPY_BANDS, COPY_ROWS).T:
        keys = _again(keys ^ row)
    return keys.view(np.int64)


def _sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen in a word."""
    low = np.zeros(16 * len(SKETCH), np.uint64)
    low[: len(least)] = least & np.uint64(15)
    return (low.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _copy_marks(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns and ``_m``: 128 bits of the words in order, the number of distinct shingles, their SimHash, sketch and bands' keys."""

    @F.pandas_udf(f"w0 long, w1 long, n long, fp long, {', '.join(f'{c} long' for c in SKETCH)}, keys array<long>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            joined, starts, ends = _cut(text)
            hashes = _shingle_hashes(joined, starts, ends, COPY_SHINGLE)
            shingles = np.unique(hashes)
            least = _minima(shingles)
            keys = _band_keys(least) if len(shingles) else np.zeros(0, np.int64)
            out.append((*np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64).tolist(), len(shingles), _signed(_votes(hashes)), *_sketch(least).tolist(), keys))
        return pd.DataFrame(out, columns=["w0", "w1", "n", "fp", *SKETCH, "keys"])

    return docs.withColumn("_m", marks(F.col(text_col)))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _long_enough(n: Column, m: Column) -> Column:
    """Sets of so different sizes cannot be alike."""
    part, whole = COPY_LIKENESS
    return whole * F.least(n, m) >= part * F.greatest(n, m)


def _may_be_alike(n: str, m: str, suffix: str) -> Column:
    """Sizes and sketches leave the similarity open; what this refuses is below it."""

    def apart(c: str) -> Column:
        x = F.col(c).bitwiseXOR(F.col(c + suffix))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_NIBBLES)))

    return _long_enough(F.col(n), F.col(m)) & (reduce(Column.__add__, map(apart, SKETCH)) <= SKETCH_RADIUS)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, shingles) have the similarity."""
    part, whole = COPY_LIKENESS

    @F.pandas_udf("boolean")
    def test(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(whole * both >= part * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").filter(test("x", "y")).select("a", "b")


def _simhash_pairs(nodes: DataFrame, scratch: Scratch, bucket: int) -> DataFrame:
    """Pairs that connect what SimHash links: each fingerprint's texts with its first, and the firsts of linked fingerprints."""
    firsts = scratch.narrow(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    same = nodes.select("fp", "node").join(firsts, "fp").filter("node <> first").select(*_ordered(F.col("first"), F.col("node")))
    found = links(firsts.select("fp"), scratch, bucket=bucket)
    one, two = (firsts.select(F.col("fp").alias(c), F.col("first").alias("n" + c)) for c in "ab")
    return same.unionByName(found.join(one, "a").join(two, "b").select(*_ordered(F.col("na"), F.col("nb")))).distinct()


def _star_pairs(rows: DataFrame) -> DataFrame:
    """In each bucket, every row with the middle of the bucket if that has another root: linear in the rows.

    Copies of one text are closer to it than to each other, so it shares more
    buckets: the middle is the row with the most rows in all its buckets.
    """
    sizes = rows.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("size"))
    degrees = rows.select("key", "node").join(sizes, F.col("key") == F.col("_k")).groupBy(F.col("node").alias("_n")).agg(F.sum("size").alias("degree"))
    ranked = rows.join(degrees, F.col("node") == F.col("_n")).select(*rows.columns, "degree")
    lead = ranked.groupBy("key").agg(F.max(F.struct("degree", "node", "root", "n", *SKETCH)).alias("l"))
    flat = lead.select(F.col("key").alias("_key"), F.col("l.root").alias("root_l"), F.col("l.node").alias("node_l"), F.col("l.n").alias("n_l"), *(F.col(f"l.{s}").alias(s + "_l") for s in SKETCH))
    met = rows.join(flat, (F.col("key") == F.col("_key")) & (F.col("root") != F.col("root_l")) & _may_be_alike("n", "n_l", "_l"))
    return met.select(*_ordered(F.col("node"), F.col("node_l"))).distinct()


def _dealt(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """The rows with ``part``: buckets are cut into parts of about ``most`` in weight."""
    parts = rows.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.sum(weight) / most).cast("long").alias("_parts"))
    return rows.join(parts, F.col("key") == F.col("_k")).select(*rows.columns, F.pmod(F.xxhash64("node"), "_parts").alias("part"), "_parts")


def _open_rows(rows: DataFrame, bucket: int) -> DataFrame:
    """The rows whose bucket has another root's row that may be alike; parts of ``bucket`` rows meet one after the other."""
    dealt = _dealt(rows, F.lit(1), bucket)
    other = dealt.select(
        F.col("key").alias("key_r"), F.col("n").alias("n_r"), F.col("root").alias("root_r"), *(F.col(s).alias(s + "_r") for s in SKETCH), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part_r")
    )
    met = (F.col("key") == F.col("key_r")) & (F.col("part") == F.col("part_r")) & (F.col("root") != F.col("root_r")) & _may_be_alike("n", "n_r", "_r")
    return dealt.join(other, met, "left_semi").drop("part", "_parts")


class _Rows:
    """Rows of one bucket with their shingle sets."""

    def __init__(self, rows: list[dict]):
        self.node, self.root, self.n = (np.array([r[c] for r in rows], np.int64) for c in ("node", "root", "n"))
        self.sketch = np.array([[r[c] for c in SKETCH] for r in rows], np.int64).view(np.uint64)
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]

    def part(self, pick: np.ndarray) -> "_Rows":
        out = object.__new__(_Rows)
        out.node, out.root, out.n, out.sketch = self.node[pick], self.root[pick], self.n[pick], self.sketch[pick]
        out.sets = [self.sets[i] for i in pick]
        return out

    def blocks(self) -> Iterator["_Rows"]:
        """Cuts of ``BLOCK_ROWS`` rows at most, and ``BLOCK_SHINGLES`` shingles unless one row has more."""
        first, total = 0, 0
        for i, n in enumerate(self.n.tolist()):
            if i > first and (i - first == BLOCK_ROWS or total + n > BLOCK_SHINGLES):
                yield self.part(np.arange(first, i))
                first, total = i, 0
            total += n
        yield self.part(np.arange(first, len(self.n)))

    def alike(self, other: "_Rows", same: bool) -> np.ndarray:
        """Pairs (i, j) of different roots whose sets have the similarity."""
        part, whole = COPY_LIKENESS
        n, m = self.n[:, None], other.n[None, :]
        ask = (self.root[:, None] != other.root[None, :]) & (whole * np.minimum(n, m) >= part * np.maximum(n, m))
        x = self.sketch[:, None, :] ^ other.sketch[None, :, :]
        x |= x >> np.uint64(2)
        x = (x | x >> np.uint64(1)) & np.uint64(_NIBBLES)
        ask &= np.bitwise_count(x).sum(axis=2, dtype=np.int64) <= SKETCH_RADIUS
        if same:
            ask = np.triu(ask, 1)
        if not ask.any():
            return np.zeros((0, 2), np.int64)
        common = self.common(other)
        return np.argwhere(ask & (whole * common >= part * (n + m - common)))

    def common(self, other: "_Rows") -> np.ndarray:
        """Sizes of the intersections, by products of incidence matrices over slabs of the shared shingles."""
        mine, its = np.concatenate(self.sets), np.concatenate(other.sets)
        words = np.intersect1d(mine, its)
        out = np.zeros((len(self.sets), len(other.sets)), np.int64)

        def places(flat: np.ndarray, rows: "_Rows") -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
            hit = words[at] == flat if len(words) else np.zeros(len(flat), bool)
            row, col = np.repeat(np.arange(len(rows.sets)), rows.n)[hit], at[hit]
            order = np.argsort(col, kind="stable")
            return row[order], col[order]

        (r1, c1), (r2, c2) = places(mine, self), places(its, other)
        for lo in range(0, len(words), 4_096):
            x, y = (np.zeros((len(out_rows), min(4_096, len(words) - lo)), np.float32) for out_rows in (self.sets, other.sets))
            for matrix, row, col in ((x, r1, c1), (y, r2, c2)):
                i, j = np.searchsorted(col, [lo, lo + 4_096])
                matrix[row[i:j], col[i:j] - lo] = 1
            out += np.rint(x @ y.T).astype(np.int64)
        return out


def _settle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (key, part), sorted so: the part's own rows come first, those of later parts meet them.

    Only what joins two classes of the run is emitted; memory holds the part and one batch.
    """

    def join(one: _Rows, two: _Rows, same: bool, root: dict[int, int]) -> Iterator[tuple[int, int]]:
        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, p in enumerate(one.blocks()):
            for j, q in enumerate(two.blocks()):
                if same and j < i:
                    continue
                for k, m in p.alike(q, same and i == j).tolist():
                    x, y = top(int(p.root[k])), top(int(q.root[m]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        yield int(p.node[k]), int(q.node[m])

    run, own, held, root = None, [], None, {}
    for batch in _with_end(batches):
        rows = batch.to_pylist() if batch is not None else []
        found, at = [], 0
        while at < len(rows) or batch is None:
            r = rows[at] if at < len(rows) else None
            here = r and (r["key"], r["part"])
            if r is None or here != run or r["later"]:
                if own:
                    held, own = _Rows(own), []
                    found += join(held, held, True, root)
                if here != run:
                    run, held, root = here, None, {}
                if r is None:
                    break
            if not r["later"]:
                own.append(r)
                at += 1
                continue
            stop = at
            while stop < len(rows) and rows[stop]["later"] and (rows[stop]["key"], rows[stop]["part"]) == run:
                stop += 1
            if held is not None:
                found += join(_Rows(rows[at:stop]), held, False, root)
            at = stop
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])


def _cross_links(rows: DataFrame, sets: DataFrame, bucket: int) -> DataFrame:
    """(a, b): links that connect what is alike among the rows of each bucket, tested on the sets; no pair is ever a row."""
    parts = _dealt(_open_rows(rows, bucket), 8 * F.col("n"), PART_BYTES)
    meets = parts.drop("_parts").withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))))
    told = meets.select("key", F.col("_o").alias("part"), (F.col("_o") < F.col("part")).alias("later"), "node", "root", "n", *SKETCH)
    full = told.join(sets.select(F.col("node").alias("_n"), "shingles"), F.col("node") == F.col("_n")).drop("_n")
    return full.repartition("key", "part").sortWithinPartitions("key", "part", "later").mapInArrow(_settle_sets, "a long, b long").distinct()


def _joined_roots(roots: DataFrame, good: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) after the links ``good`` (a, b) have joined what ``roots`` had apart."""
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
    edges = good.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = components(edges, scratch, name + "_").withColumnsRenamed({"node": "_old", "root": "_new"})
    out = roots.join(moved, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
    return scratch.narrow(out, name)


def copy_roots(nodes: DataFrame, texts: DataFrame, scratch: Scratch, bucket: int) -> DataFrame:
    """(node, root) of the links among nodes (node, n, fp, sketch, keys) with ``texts`` (node, text); lone nodes may lack.

    Every link is confirmed on the whole shingle sets.  First what the covering
    family links, within ``RADIUS`` bits of the SimHash of the shingles: the
    closest copies, whole groups at once.  Then pairs that share a MinHash band,
    where other links do not connect them already (or sizes or sketches rule
    them out): one round of stars settles most of each bucket; what is still
    apart is tested inside tasks, and only links come out.
    """

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_shingle_hashes(*_cut(t), COPY_SHINGLE)).tobytes() for t in texts], dtype=object)

    close = scratch.narrow(_simhash_pairs(nodes, scratch, bucket), "close")
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    rows = scratch.narrow(keyed.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1").select("key", "node"), "rows")
    scratch.drop("firsts", "crowded")
    known = rows.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node"))).distinct()
    facts = scratch.narrow(nodes.join(known, "node", "left_semi").select("node", "n", *SKETCH), "facts")
    known = facts.select("node")
    sets = scratch.bucketed(texts.join(known, "node", "left_semi").select("node", shingles("text").alias("shingles")), "sets", "node")
    scratch.drop("nodes")
    roots = _joined_roots(facts.select("node", F.col("node").alias("root")), _alike(close, sets), scratch, "roots0")
    for k, links_of in enumerate((lambda r: _alike(_star_pairs(r), sets), lambda r: _cross_links(r, sets, bucket)), 1):
        rooted = rows.join(roots, "node")
        apart = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        rooted = scratch.narrow(rooted.join(apart, "key", "left_semi").join(facts, "node"), f"apart{k}")
        roots = _joined_roots(roots, links_of(rooted), scratch, f"roots{k}")
    scratch.drop("close", "rows", "facts", "sets", "apart1", "apart2")
    return roots


def drop_copies(docs: DataFrame, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: the one with the smallest id.

    Near copies are texts whose sets of five-word shingles (words in lower case)
    have a Jaccard similarity of 0.8 or more, and what such pairs connect.
    Candidates are texts whose SimHash of those shingles the covering family
    links, and texts that share a band of MinHash minima, which reaches the
    pairs near 0.8 that lie beyond SimHash's radius; a candidate becomes a link
    only if the sets themselves, as 64-bit hashes, have the similarity.

    Null and empty texts are copies of each other; very long texts are read
    whole; null ids are kept last; of repeated rows one stays; an empty table
    gives an empty result; columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    columns = docs.columns
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXT_ROWS, **FREE_SHUFFLE):
        boxed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        # The one exchange that moves texts; later joins come to them.
        marked = scratch.bucketed(_copy_marks(boxed, "text").drop("text").withColumn("rid", F.monotonically_increasing_id()), "marked", "rid")
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
        first = marked.select("id", "rid", "_m.w0", "_m.w1").groupBy("w0", "w1").agg(F.min(place).alias("least"))
        distinct = scratch.narrow(first.select(F.col("least.rid").alias("node"), "least"), "distinct")
        once = marked.join(distinct.select("node"), F.col("rid") == F.col("node"), "left_semi")
        nodes = scratch.write(once.select(F.col("rid").alias("node"), *(F.col("_m").getField(c).alias(c) for c in ("n", "fp", *SKETCH, "keys"))), "nodes")
        texts = marked.select(F.col("rid").alias("node"), F.col("row").getField(text_col).alias("text"))
        roots = copy_roots(nodes, texts, scratch, bucket).withColumnRenamed("node", "_node")
        rooted = distinct.join(roots, F.col("node") == F.col("_node"), "left").select("least", F.coalesce("root", "node").alias("root"))
        kept = scratch.narrow(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.rid").alias("_rid")), "kept")
    scratch.drop("distinct", "roots0", "roots1", "roots2")
    return marked.join(kept, F.col("rid") == F.col("_rid"), "left_semi").select(*(F.col("row").getField(c).alias(c) for c in columns))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
