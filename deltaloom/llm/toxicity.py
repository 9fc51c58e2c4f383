"""Toxicity by a small convolutional text classifier, trained in numpy.

Words and their character n-grams are hashed into an embedding table; filters of one to three words slide
over the whole text, each keeps its maximum, and a logistic layer weighs those.
The raw output is calibrated so that the best operating point on held-back
training rows lies at a score of ``CUT``; on top of that every language gets a
threshold of its own, used for decisions, never for the score.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many labelled rows are fitted: the ones with the smallest hash of their id.
TRAIN_ROWS = 8_000
#: Of those, in the same order, as many as have this many bytes of text together.
TRAIN_BYTES = 128 << 20
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Lengths of the character n-grams that share in a word's vector.
GRAMS = (4, 6, 7)
EPOCHS = 8
RATE = 0.1
BATCH = 32
CUT = 0.3
HELD_OUT = 2
#: A language with fewer labelled toxic rows than this in the calibration part takes the common threshold.
LANG_POSITIVES = 20
CACHE_WORDS = 300_000
#: Column that :func:`score` adds.
SCORE = "__toxicity_score"
_PAD = max(WIDTHS) - 1
_WORD = regex.compile(r"\w+").findall


def buckets(word: str) -> list[int]:
    """Buckets of a word: its own and those of its character n-grams, 1 to BUCKETS - 1; 0 is padding."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return [1 + zlib.crc32(g.encode()) % (BUCKETS - 1) for g in (word, *sorted(grams))]


class Words(dict):
    """Word -> row; the buckets of row r are ``flat[ends[r - 1] : ends[r]]``.  Row 0 is padding."""

    def __init__(self) -> None:
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.ends = array("i", [0]), array("i", [1])

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self.ends)
        self.flat.extend(buckets(word))
        self.ends.append(len(self.flat))
        return row

    def rows(self, text: str | None) -> np.ndarray:
        words = _WORD(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def gather(embed: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word vectors: sums of bucket vectors over the root of their number."""
    total = np.add.reduceat(embed[flat], starts, axis=0)
    return total / np.sqrt(sizes)[:, None].astype(np.float32)


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids with padding after each document; where documents start and how many windows each has."""
    pad = np.zeros(_PAD, np.int32)
    sizes = np.array([max(1, len(d)) for d in docs])
    ids = np.concatenate([x for d in docs for x in ((d if len(d) else np.zeros(1, np.int32)), pad)])
    starts = np.concatenate([[0], np.cumsum(sizes + _PAD)[:-1]])
    return ids, starts, sizes


@dataclass
class Network:
    embed: np.ndarray
    convs: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    by_lang: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        embed[0] = 0
        convs = [rng.normal(0, 1 / np.sqrt(DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(embed, convs, np.zeros(n, np.float32), rng.normal(0.3, 0.1, n).astype(np.float32))

    def features(self, docs: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pooled maxima, the window each came from, the joined rows and their vectors."""
        ids, starts, sizes = _joined(docs)
        x = vectors[ids]
        n = len(ids) - _PAD
        pooled, best = [], []
        for conv, w in zip(self.convs, WIDTHS, strict=True):
            z = x[:n] @ conv[0]
            for o in range(1, w):
                z += x[o : n + o] @ conv[o]
            at = np.stack([s + z[s : s + k].argmax(axis=0) for s, k in zip(starts, sizes, strict=True)])
            best.append(at)
            pooled.append(z[at, np.arange(FILTERS)])
        return np.concatenate(pooled, axis=1), np.concatenate(best, axis=1), ids, x

    def raw(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        pooled = np.maximum(self.features(docs, vectors)[0] + self.bias, 0)
        return (pooled @ self.out + self.out_bias).astype(np.float64)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raw), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))


class Scorer:
    """A network with the vectors of the words that this worker has met."""

    def __init__(self, net: Network):
        self.net, self.words = net, Words()
        self.vectors = np.zeros((1, DIM), np.float32)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > CACHE_WORDS:
            self.words.reset()
            self.vectors = self.vectors[:1]
        rows = [self.words.rows(t) for t in texts]
        known, ends = len(self.vectors), self.words.ends
        if known < len(ends):
            starts = np.array(ends[known - 1 : -1])
            sizes = np.array(ends[known:]) - starts
            flat = np.array(self.words.flat[starts[0] :])
            self.vectors = np.concatenate([self.vectors, gather(self.net.embed, flat, starts - starts[0], sizes)])
        return self.net.raw(rows, self.vectors)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.net.calibrated(self.raw(texts))


def _adam(value, grad, state, t, rate):
    m, v = state
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def train(docs: list[np.ndarray], words: Words, labels: np.ndarray, seed: int = 7) -> Network:
    """Logistic loss with balanced classes; gradients flow through the pooled windows alone."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    flat, ends = np.array(words.flat), np.array(words.ends)
    begins = np.concatenate([[0], ends[:-1]])
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    params = [*net.convs, net.bias, net.out]
    states = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    squares = np.full(BUCKETS, 1e-6, np.float32)  # Adagrad over the embedding rows in use

    def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat buckets of the rows, where each row's begin, and how many it has."""
        sizes = ends[rows] - begins[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return flat[np.repeat(begins[rows] - starts, sizes) + np.arange(sizes.sum())], starts, sizes

    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            used, local = np.unique(np.concatenate([[0], *(docs[i] for i in pick)]), return_inverse=True)
            cuts = np.cumsum([1, *(len(docs[i]) for i in pick)])
            mine = np.split(local.astype(np.int32), cuts)[1 : 1 + len(pick)]
            pooled, best, ids, x = net.features(mine, gather(net.embed, *spread(used)))
            act = pooled + net.bias
            on = (act > 0).astype(np.float32)
            hidden = act * on
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
            err = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = err[:, None] * net.out[None, :] * on
            t += 1
            grads, touched, moved = [], [], []
            for k, (conv, w) in enumerate(zip(net.convs, WIDTHS, strict=True)):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                where, g = best[:, cols], back[:, cols]
                grad = np.empty_like(conv)
                for o in range(w):
                    grad[o] = np.einsum("bf,bfd->df", g, x[where + o])
                    touched.append(ids[where + o].ravel())
                    moved.append((g[:, :, None] * conv[o].T[None]).reshape(-1, DIM))
                grads.append(grad + 1e-4 * conv)
            grads += [back.sum(axis=0), hidden.T @ err + 1e-4 * net.out]
            for p_, g_, s_ in zip(params, grads, states, strict=True):
                _adam(p_, g_, s_, t, 0.01)
            net.out_bias -= 0.05 * float(err.sum())
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(moved))
            own, _, sizes = spread(used[rows])
            each = np.repeat(total / np.sqrt(sizes)[:, None].astype(np.float32), sizes, axis=0)
            slots, inverse = np.unique(own, return_inverse=True)
            grad = np.zeros((len(slots), DIM), np.float32)
            np.add.at(grad, inverse, each)
            squares[slots] += (grad * grad).mean(axis=1)
            net.embed[slots] -= RATE * grad / np.sqrt(squares[slots])[:, None]
            net.embed[0] = 0
    return net


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1, midway to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # a threshold cannot part equal scores
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1e-6)


def fit(texts: list[str | None], labels: np.ndarray, langs: list[str | None], held_back: np.ndarray) -> Network:
    """Trains on the rows that are not held back, calibrates on those that are."""
    known = ~held_back
    if len(texts) == 0 or not 0 < labels[known].sum() < known.sum():
        net = Network.fresh()
        net.constant = 0.0 if len(texts) == 0 or labels.mean() < 0.5 else 1.0
        return net
    words = Words()
    net = train([words.rows(t) for t, k in zip(texts, known, strict=True) if k], words, labels[known])
    scorer = Scorer(net)
    raw = np.concatenate([scorer.raw(texts[i : i + 64]) for i in range(0, len(texts), 64)])
    use = held_back if 0 < labels[held_back].sum() < held_back.sum() else known
    cut = best_cut(raw[use], labels[use])
    spread = max(1e-3, raw[use & (labels == 1)].mean() - raw[use & (labels == 0)].mean())
    net.scale = 6.0 / spread
    net.shift = np.log(CUT / (1 - CUT)) - net.scale * cut
    score = 1 / (1 + np.exp(-np.clip(net.scale * raw + net.shift, -30, 30)))
    lang = np.array([x or "" for x in langs], dtype=object)
    for name in sorted(set(lang[use])):
        own = use & (lang == name)
        if name and labels[own].sum() >= LANG_POSITIVES and labels[own].sum() < own.sum():
            net.by_lang[name] = min(0.9, max(0.05, best_cut(score[own], labels[own])))
    return net


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", max_bytes: int = TRAIN_BYTES) -> Network:
    """Fits on at most ``max_rows`` labelled rows outside the held-out remainder.

    Rows of equal id count as one label each, toxic if any says so.  Of the rows
    of one id one is fitted, the one with the smallest hash of language and
    text, so ``max_rows`` bounds rows and ``max_bytes`` their texts, however
    often an id repeats.  One task trains on them; a lost one is run again.
    """
    ok = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    ok = ok.filter(F.pmod(F.crc32(F.col("k").cast("string").cast("binary")), F.lit(4)) != HELD_OUT).groupBy("k").agg(F.max("y").cast("int").alias("y"))
    chosen = ok.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    # ``chosen`` holds max_rows narrow rows at most: the bound that lets it be broadcast.
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    each = rows.select("id", "y", F.struct(F.xxhash64("lang", "text").alias("h"), "lang", "text").alias("row"))
    chosen_rows = each.groupBy("id", "y").agg(F.min("row").alias("row")).select(F.xxhash64("id").alias("at"), F.col("id").cast("string").alias("id"), "y", "row.lang", "row.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, room = [], max_bytes
        for batch in batches:
            for r in batch.to_pylist():
                room -= len((r["text"] or "").encode())
                if room < 0:
                    break
                got.append(r)
        got.sort(key=lambda r: (r["id"], r["lang"] or "", r["text"] or ""))
        held_back = np.array([zlib.crc32(r["id"].encode()) % 4 == 3 for r in got], dtype=bool)
        net = fit([r["text"] for r in got], np.array([r["y"] for r in got], np.int64), [r["lang"] for r in got], held_back)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # ``max_rows`` and ``max_bytes`` bound what meets in the one task; the driver receives the weights alone.
    trained = chosen_rows.repartition(1).sortWithinPartitions("at", "id").mapInArrow(run, "net binary").first()
    return pickle.loads(bytes(trained["net"])) if trained else fit([], np.zeros(0, np.int64), [], np.zeros(0, bool))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``SCORE``: the toxicity of every whole text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(net)

    def run(texts: Iterator) -> Iterator:
        import pandas as pd

        scorer = Scorer(sent.value)
        for part in texts:
            values = part.tolist()
            out = [scorer(values[i : i + 64]) for i in range(0, len(values), 64)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    # The annotation tells Spark the kind of function.
    import pandas as pd

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(SCORE, F.pandas_udf(run, "double")(F.col(text_col)))


def threshold_of(net: Network, lang_col: str = "lang"):
    """The language's calibrated threshold, else the common one."""
    out = F.lit(CUT)
    for name, cut in sorted(net.by_lang.items()):
        out = F.when(F.col(lang_col) == name, cut).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, score, predicted (score >= CUT), lang_threshold, flagged (score >= lang_threshold).

    Labels only fit the network, and only those whose id has another remainder
    than ``HELD_OUT``; language decides ``flagged`` alone.  A null text counts
    as empty and is scored; very long texts are scored whole; a null id is never
    held out; repeated rows pass through; without usable labels of both classes
    the score is a constant; a table without a language column takes the common
    threshold; an empty table gives an empty result; other columns are not read.
    """
    if lang_col not in docs.columns:
        docs = docs.withColumn(lang_col, F.lit(None).cast("string"))
    net = fit_on(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col)
    scored = score(docs.select(id_col, lang_col, text_col), net, id_col, text_col)
    held_out = F.coalesce(_remainder(id_col) == HELD_OUT, F.lit(False))
    return scored.select(
        id_col, held_out.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= CUT).cast("int").alias("predicted"), threshold_of(net, lang_col).alias("lang_threshold"), (F.col(SCORE) >= threshold_of(net, lang_col)).alias("flagged")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
