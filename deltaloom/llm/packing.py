"""Packing of documents into fixed-length sequences, shortest pack first.

1. Every text is tokenized once; a document longer than a sequence is cut into
   full pieces and one rest.  Each task numbers its pieces of equal length.
2. The histogram of piece lengths (``max_len`` bins, whatever the corpus) goes
   to the driver.  Lengths are placed longest first, each into the packs with
   most room left, as counts: packs of one filling are a numbered range that is
   split when only part of it receives the length.
3. A placement is an interval of ranks of one length, so a piece finds its
   sequence and offset from (length, rank) alone.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .token_counts import _UNSURE, load_tokenizer

MAX_LEN = 4096
END_ID = 2
CACHE_WORDS = 250_000
_RANK_BITS = 44

#: Blanks on which the tokenizer's normalizer and ``str.split`` may differ.
_UNSURE_BLANK = regex.compile(r"[\x1c-\x1f᠎​﻿]")


_word_ids: dict[str, "WordIds"] = {}


def word_ids(path: str) -> "WordIds":
    """The worker's cache for a tokenizer; it outlives a task."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(load_tokenizer(path))
    return _word_ids[path]


#: Fixed value: how the tokenizer cuts its normalized text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class PieceIds(dict):
    """Normalized piece of a word -> its ids, straight from the vocabulary's merges."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        byte_level = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        self.symbols = {b: chr(b) for b in byte_level}
        self.symbols |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in self.symbols)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        symbols = piece if piece.isascii() and piece.isalnum() else "".join(map(self.symbols.__getitem__, piece.encode()))
        ids = self[piece] = np.array([t.id for t in self.tokenize(symbols)], dtype="<u4").tobytes()
        return ids


class WordIds(dict):
    """Blank-separated word -> its ids, little-endian, 4 bytes each.

    The tokenizer drops blanks before it looks at words, so a text's ids are
    its words' ids in a row, and a word's are its pieces' ids.  Words with a
    special string or with characters that the two libraries may not class
    alike go to the tokenizer itself.  A full cache starts over.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.pieces, self.find = tokenizer, PieceIds(tokenizer), regex.compile(PIECE).findall

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or "\u03a3" in word or not word.isascii() and _UNSURE.search(word):  # a capital sigma's lower case differs
            ids = self.encode(word)
        else:
            plain = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            ids = b"".join(map(self.pieces.__getitem__, self.find(plain)))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text.isascii() and _UNSURE_BLANK.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def cut(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text with ``_part`` and ``_k``: the task, and the piece's number of its length there."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            row, start, length, crc, total, rank = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (words.ids(text) if text else b"") + end
                n = len(raw) // 4
                for at in range(0, n, max_len):
                    size = min(max_len, n - at)
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    total.append(n)
                    rank.append(seen[size])
                    seen[size] += 1
            columns = [pa.array(c, pa.int64()) for c in (start, length, crc, total, [part] * len(row), rank)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_k"])

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _part long, _k long")
    return out.withColumnRenamed("_id", id_col)


def place_lengths(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset).

    Ranks ``first rank .. + count`` of that length go to the sequences from
    ``first sequence`` on, one each, at ``offset``.  At most two ranges of packs
    arise per length, so the list is bounded by ``max_len`` alone.
    """
    out: list[tuple[int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # (-room, first sequence, count): a heap, most room first
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and -packs[0][0] >= length:
                room, first, count = heapq.heappop(packs)
                used = min(count, left)
                if used < count:
                    heapq.heappush(packs, (room, first + used, count - used))
            else:
                room, first, used = -max_len, sequences, left
                sequences += left
            out.append((length, rank, used, first, max_len + room))
            if -room > length:
                heapq.heappush(packs, (room + length, first, used))
            left -= used
            rank += used
    return out


def pack(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and gives one piece, the end id.  Null ids,
    repeated rows and texts of any length are pieces like any other; ties
    between equal lengths fall to scan order; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut(docs, path, max_len, end_id, id_col, text_col), "pieces")
    per_task = pieces.groupBy("_part", "length").agg((F.max("_k") + 1).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task and length: the window's groups hold a row per task, not per piece.
    offsets = per_task.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    bins = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    placed = sorted(place_lengths({r["length"]: r["n"] for r in bins}, max_len))
    table = np.array(placed, dtype=np.int64).reshape(-1, 5)
    lookup = spark.sparkContext.broadcast((table[:, 0] << _RANK_BITS | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first_rank, first_sequence, offset = lookup.value
        at = np.searchsorted(key, length.to_numpy() << _RANK_BITS | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": first_sequence[at] + rank.to_numpy() - first_rank[at], "offset": offset[at]})

    ranked = pieces.join(offsets, ["_part", "length"])
    found = ranked.withColumn("_at", find("length", F.col("_before") + F.col("_k")))
    return found.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.offset")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
