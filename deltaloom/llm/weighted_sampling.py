"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, weight the word's count.  For each of ``SAMPLES``
samples every word has fixed draws r, c ~ Gamma(2, 1) and b ~ U(0, 1), taken
from its hash.  With weight w: t = floor(ln w / r + b), and the sampled word is
the one with the smallest ln c - r (t - b + 1).  Two texts give the same
(word, t) with probability sum(min) / sum(max) of their weights: the share of
equal samples estimates the generalised Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 64
SEED = 42
CACHE_WORDS = 100_000
#: Words whose draws are made at once, texts that are signed together, and the code points that end such a chunk.
PIECE_WORDS = 20_000
CHUNK = 64
CHUNK_CHARS = 1 << 20
_WORD = re.compile(r"\S+").finditer
_NONE = np.full(SAMPLES, 0xFFFF, np.uint16)  # of a text without words


def _scramble(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Signatures of texts; the draws of words met before are kept, up to ``CACHE_WORDS``."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.size = 0
        self.base = np.zeros((1024, SAMPLES), np.float32)  # ln c - r (1 - b): the value at weight 1
        self.r = np.zeros_like(self.base)
        self.b = np.zeros_like(self.base)
        self.hash = np.zeros(1024, np.uint64)
        self.sample = (np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def _learn(self, words: list[str]) -> None:
        need = self.size + len(words)
        if need > len(self.hash):
            grow = max(need, 2 * len(self.hash)) - len(self.hash)
            self.base, self.r, self.b = (np.pad(m, ((0, grow), (0, 0))) for m in (self.base, self.r, self.b))
            self.hash = np.pad(self.hash, (0, grow))
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode(), SEED) for w in words), np.uint64, len(words))
        state = _scramble(h[:, None] + self.sample[None, :])

        def uniform(k: int) -> np.ndarray:
            bits = _scramble(state + np.uint64(0xD1B54A32D192ED03 * k & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)
            return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

        r = -np.log(uniform(1) * uniform(2))
        log_c = np.log(-np.log(uniform(3) * uniform(4)))
        b = uniform(5)
        at = slice(self.size, need)
        self.base[at], self.r[at], self.b[at], self.hash[at] = log_c - r * (1 - b), r, b, h
        self.row.update(zip(words, range(self.size, need), strict=True))
        self.size = need

    def signatures(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ``SAMPLES`` 16-bit codes per text."""
        out, group, room = [], [], PIECE_WORDS
        for t in texts:
            bag = Counter(m.group() for m in _WORD(t.lower()))
            if len(bag) > room and group:
                out += self._signed(group)
                group, room = [], PIECE_WORDS
            group.append(bag)
            room -= len(bag)
        return out + self._signed(group)

    def _signed(self, bags: list[Counter]) -> list[np.ndarray]:
        """Codes of bags that have ``PIECE_WORDS`` words together, or of one larger bag."""
        if len(bags) == 1 and len(bags[0]) > PIECE_WORDS:
            return [self._in_pieces(bags[0])]
        self._know(set().union(*bags))
        return [self._sign(bag)[1] if bag else _NONE for bag in bags]

    def _in_pieces(self, bag: Counter) -> np.ndarray:
        """The minimum is associative: codes of the smallest values among the pieces'."""
        words, best, codes = sorted(bag), np.full(SAMPLES, np.inf, np.float32), _NONE
        for i in range(0, len(words), PIECE_WORDS):
            piece = {w: bag[w] for w in words[i : i + PIECE_WORDS]}
            self._know(set(piece))
            value, code = self._sign(piece)
            best, codes = np.where(value < best, value, best), np.where(value < best, code, codes)
        return codes

    def _know(self, words: set[str]) -> None:
        if self.size > CACHE_WORDS:
            self.row.clear()
            self.size = 0
        new = words.difference(self.row)
        if new:
            self._learn(sorted(new))

    def _sign(self, bag: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The smallest value of each sample, and its code; the bag's words are known."""
        rows = np.fromiter(map(self.row.__getitem__, bag), np.int64, len(bag))
        weight = np.fromiter(bag.values(), np.int64, len(bag))
        rows = np.concatenate([rows[weight == 1], rows[weight > 1]])
        heavy = weight[weight > 1]
        once = len(rows) - len(heavy)
        value = self.base[rows]
        t = np.zeros((len(heavy), SAMPLES), np.float32)
        if len(heavy):
            r = self.r[rows[once:]]
            t = np.floor(np.log(heavy).astype(np.float32)[:, None] / r + self.b[rows[once:]])
            value[once:] -= r * t
        best = value.argmin(axis=0)
        steps = np.where(best >= once, t[np.maximum(best - once, 0), np.arange(SAMPLES)] if len(heavy) else 0, 0)
        code = _scramble(self.hash[rows[best]] + self.sample + steps.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return value[best, np.arange(SAMPLES)], (code >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def fingerprint_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the following text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (part, late, _id, _text), each part a range of ids, in falling order, with its successor.

    One exchange moves every text once.  Bounds come from the narrow id column
    (a quantile sketch; one number per part reaches the driver); the first
    document of each part is sent to the part before as well, marked ``late``.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("_id"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = narrow.agg(F.percentile_approx("_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64)) if n > 1 else np.zeros(0, np.int64)
    last = len(bounds)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), last)
        out[known] = last - np.searchsorted(bounds, ids[known].to_numpy(dtype=np.int64), side="left")
        return pd.Series(out)

    heads = sorted((r["part"], r["head"]) for r in narrow.groupBy(part_of("_id").alias("part")).agg(F.max("_id").alias("head")).collect())
    parts = [p for p, _ in heads]
    before = {heads[i][0]: parts[i - 1] for i in range(len(heads))}
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("part", part_of("_id"))
    # One row per part, whatever the data.
    table = spark.createDataFrame([(p, h, before[p]) for p, h in heads], "_p int, _head long, _before int")
    joined = rows.join(F.broadcast(table), F.col("part") == F.col("_p"), "left")
    own = F.struct("part", F.lit(False).alias("late"))
    extra = F.struct(F.col("_before").alias("part"), F.lit(True).alias("late"))
    places = F.when(F.col("_id").eqNullSafe(F.col("_head")), F.array(own, extra)).otherwise(F.array(own))
    sent = joined.select("_id", "_text", F.explode(places).alias("_at")).select("_at.part", "_at.late", "_id", "_text")
    dealt = sent.repartitionById(last + 1, F.col("part"))
    return dealt.sortWithinPartitions("late", F.desc_nulls_last("_id"), "_text"), last + 1


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and two likenesses.

    Documents stand in falling order of id (null ids last, ties by text); the
    one after the last is the first, so a single document follows itself.  A
    null text counts as empty; texts without words have a fingerprint of their
    own, equal among themselves; of a very long text ``PIECE_WORDS`` words are
    drawn for at a time.  Repeated rows follow each other like any documents; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            """Rows of all but the last text, which only follows."""
            edited = [edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            own, other = np.split(np.array(sampler.signatures(texts + edited)), [len(texts)])
            n = len(edited)
            columns = [
                pa.array(ids[:n], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([fingerprint_text(s) for s in own[:n]]),
                pa.array([fingerprint_text(s) for s in other]),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ids, texts, done = [], [], False
        for batch in batches:
            for late, i, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if done or late and not texts:
                    continue
                ids.append(i)
                texts.append(text)
                done = late
                if len(texts) > CHUNK or done or len(texts) > 1 and sum(map(len, texts)) > CHUNK_CHARS:
                    yield flush(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    rows, _ = with_next(docs, id_col, text_col)
    schema = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
