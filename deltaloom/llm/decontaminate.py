"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to
``floor(RATE * m)`` edits.  It is cut into one piece more than that: some piece
then stands in the document untouched.  Pieces of all items are sought in one
pass of an Aho-Corasick automaton; around every hit the item is verified with
Myers's bit-parallel edit distance.  Texts are compared in lower case with
blanks folded.  A map over documents: nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

RATE = 0.06
#: Characters of test items sent to the workers at once; more go in blocks of this size.
BLOCK_CHARS = 1_000_000

_matchers: dict[str, "Matcher"] = {}


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def offsets(text: str) -> list[int]:
    """For each character of ``normalize(text)``, its place in ``text``."""
    out: list[int] = []
    gap = -1
    for i, ch in enumerate(text):
        if ch.isspace():
            gap = i if out and gap < 0 else gap
            continue
        if gap >= 0:
            out.append(gap)
            gap = -1
        out.extend([i] * len(ch.lower()))
    return out


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece) of budget + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Edit distance of a pattern to every text position where a match may end."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = defaultdict(int)
        for i, ch in enumerate(pattern):
            self.peq[ch] |= 1 << i

    def ends(self, text: str, budget: int) -> list[tuple[int, int]]:
        """(end, distance) wherever the best match ending there is within budget."""
        m, get = self.m, self.peq.get
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, out = full, 0, m, []
        for j, ch in enumerate(text, 1):
            eq = get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
            if score <= budget:
                out.append((j, score))
        return out


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, raw in items:
            text = normalize(raw)
            if not text:
                continue
            budget = int(rate * len(text))
            for at, piece in pieces(text, budget):
                places[piece].append((len(self.items), at))
            self.items.append((key, text, budget, Myers(text), Myers(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, raw: str) -> list[tuple[object, int, int, int, int]]:
        """(item, start, end, distance, budget); offsets in code points of the raw text, end exclusive."""
        if not self.items:
            return []
        text = normalize(raw)
        begun: dict[int, list[int]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(text):
            for k, at in where:
                begun[k].append(last + 1 - size - at)
        out, places = [], None
        for k, starts in sorted(begun.items()):
            key, item, budget, ahead, back = self.items[k]
            for a, b in self._windows(starts, len(item), budget, len(text)):
                for end, distance in self._best(ahead.ends(text[a:b], budget), budget):
                    end += a
                    head = text[max(0, end - len(item) - budget) : end][::-1]
                    size = min((d, abs(n - len(item)), n) for n, d in back.ends(head, distance))[2]
                    places = places or offsets(raw)
                    out.append((key, places[end - size], places[end - 1] + 1, distance, budget))
        return out

    @staticmethod
    def _windows(starts: list[int], m: int, budget: int, n: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold every match begun near one of the starts; overlapping ones are one."""
        lo = hi = None
        for s in sorted(starts):
            a, b = max(0, s - budget), min(n, s + m + budget)
            if hi is not None and a <= hi:
                hi = max(hi, b)
                continue
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
        if hi is not None:
            yield lo, hi

    @staticmethod
    def _best(ends: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
        """The closest of each cluster of ends."""
        out: list[tuple[int, int]] = []
        last = None
        for end, d in ends:
            if last is not None and end - last <= budget + 1:
                if d < out[-1][1]:
                    out[-1] = (end, d)
            else:
                out.append((end, d))
            last = end
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple[object, str]], bool]]:
    """The test items in blocks of bounded size, each fetched when it is needed, and whether there are several."""
    items = benchmark.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // block_chars) if total > block_chars else 1)
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i) if n > 1 else items
        yield sorted(((r["k"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1])), n > 1


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per occurrence: id, item id, start, end, distance, budget.

    Null and empty texts and items match nothing; an item that repeats counts
    once, items of equal text under several ids are all named; repeated
    documents each get their rows; very long texts are read whole; an empty
    table gives an empty result; other columns are not read.  A benchmark of
    several blocks takes a pass each, whose hits are written before the next
    block is fetched: the driver and the workers hold one block.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind, item_kind = narrow.schema["_id"].dataType, benchmark.schema[item_col].dataType
    scratch = Scratch(spark, "decontaminate")
    found = []
    for block, more in item_blocks(benchmark, item_col, item_text, block_chars):
        sent = spark.sparkContext.broadcast(block)
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _matchers:
                _matchers.clear()
                _matchers[name] = Matcher(sent.value, rate)
            match = _matchers[name]
            for batch in batches:
                row, hits = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for hit in match.find(text) if text else ():
                        row.append(i)
                        hits.append(hit)
                cols = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.int64() if item_kind.typeName() == "long" else None, *[pa.int64()] * 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *cols], names=["_id", "_item", "start", "end", "distance", "budget"])

        hits = narrow.mapInArrow(run, f"_id {kind.simpleString()}, _item {item_kind.simpleString()}, start long, end long, distance long, budget long")
        if more:
            hits = scratch.write(hits, f"hits{len(found)}")
            sent.unpersist()
        found.append(hits)
    every = reduce(DataFrame.unionByName, found)
    return every.withColumnsRenamed({"_id": id_col, "_item": item_col})


def drop_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item; a filter in place, row by row, so repeated and null ids are no matter.

    Null and empty texts hold nothing and stay; very long texts are read whole;
    an empty table stays empty, and an empty benchmark drops nothing; all
    columns pass through, whatever their names.  A benchmark of several blocks
    takes a pass each, and what a pass leaves is written before the next.
    """
    def clean_of(sent, name):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            if name not in _matchers:
                _matchers.clear()
                _matchers[name] = Matcher(sent.value, rate)
            match = _matchers[name]
            return pd.Series([not (text and match.find(text)) for text in texts], dtype=bool)

        return clean

    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    kept = docs
    for k, (block, more) in enumerate(item_blocks(benchmark, item_col, item_text, block_chars)):
        sent = spark.sparkContext.broadcast(block)
        kept = kept.filter(clean_of(sent, uuid.uuid4().hex)(F.col(text_col)))
        if more:
            kept = scratch.write(kept, f"kept{k}")
            scratch.drop(f"kept{k - 1}")
            sent.unpersist()
    return kept


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
