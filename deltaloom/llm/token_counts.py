"""Token counts by a map-side two-tier lookup.

Tier one is a table of the most frequent pre-tokens of the whole corpus with
their token counts, built once and sent to every worker.  Its size is bounded:
``TABLE_ENTRIES`` pre-tokens of at most ``ENTRY_BYTES`` bytes.  Tier two is a
cache in each Python worker: a pre-token that the table lacks is encoded by
the tokenizer once and remembered, the cache starting over at
``CACHE_ENTRIES``.  No pre-token is shuffled; the only rows that move are the
bounded per-task summaries (``TASK_ENTRIES`` words with counts) from which the
table is built.  The table decides speed alone: counts are those of the
tokenizer whatever it holds.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_ENTRIES = 65_536
ENTRY_BYTES = 64
TASK_ENTRIES = 4_096
COUNTER_ENTRIES = 200_000
CACHE_ENTRIES = 400_000

#: Fixed value: how byte-level BPE of the 50k vocabulary cuts a text into pre-tokens.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_tokenizers: dict[str, object] = {}
_lookups: dict[tuple, "Lookup"] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, once per process, without threads of its own."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        _tokenizers[path] = tok
    return _tokenizers[path]


class PackedTable:
    """Keys and one-byte-to-four-byte values in three flat buffers; small to send."""

    def __init__(self, items: dict[str, int]):
        raw = [k.encode() for k in items]
        self.blob = b"".join(raw)
        self.ends = np.cumsum([len(k) for k in raw], dtype=np.uint32) if raw else np.zeros(0, np.uint32)
        values = np.fromiter(items.values(), np.uint32, len(items))
        self.values = values.astype(np.uint8) if not len(values) or values.max() < 256 else values

    def unpack(self) -> dict[str, int]:
        out, at = {}, 0
        for end, value in zip(self.ends.tolist(), self.values.tolist(), strict=True):
            out[self.blob[at:end].decode()] = value
            at = end
        return out


class Lookup(dict):
    """Pre-token -> tokens: the broadcast table, then the worker's own cache."""

    def __init__(self, tokenizer, table: PackedTable):
        super().__init__(table.unpack())
        self.tokenizer, self.table = tokenizer, table
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n

    def count(self, text: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.table.unpack())
        if not text.isascii() and _UNSURE.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.cut is None or not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.cut.split(text)
        return sum(sum(map(self.__getitem__, self.find(p))) for p in parts) + len(parts) - 1


#: Letters and digits that the two regular-expression libraries may not class
#: alike (they follow different editions of Unicode): outside the long-settled
#: blocks the tokenizer itself takes the whole text.
_UNSURE = regex.compile(
    r"[^\x00-\x1b\x20-ԯḀ-῿ -⁯₠-₿℀-↋　-ㄭ一-龥가-힣＀-ￜ]"
)


def _lookup(key: tuple, path: str, table: PackedTable) -> Lookup:
    if key not in _lookups:
        _lookups.clear()
        _lookups[key] = Lookup(load_tokenizer(path), table)
    return _lookups[key]


def frequent_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The corpus's most frequent blank-separated words, from bounded summaries of every task.

    Each task counts all of its texts; a counter over ``COUNTER_ENTRIES``
    keeps its upper half, so memory is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(text.split())
                    if len(seen) > COUNTER_ENTRIES:
                        seen = Counter(dict(seen.most_common(COUNTER_ENTRIES // 2)))
        best = [(w, n) for w, n in seen.most_common(TASK_ENTRIES) if len(w.encode()) <= ENTRY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    words = docs.select(text_col).mapInArrow(count, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_ENTRIES // 2)
    return [r["word"] for r in top.collect()]


def build_table(words: list[str], path: str) -> PackedTable:
    """Counts of the pre-tokens of frequent words, with and without the blank before."""
    tok, find = load_tokenizer(path), regex.compile(PRE_TOKEN).findall
    pieces: dict[str, None] = {}
    for w in words:
        for form in (" " + w, w):
            for piece in find(form):
                if len(pieces) < TABLE_ENTRIES:
                    pieces.setdefault(sys.intern(piece))
    sizes = [len(e.ids) for e in tok.encode_batch(list(pieces), add_special_tokens=False)]
    return PackedTable(dict(zip(pieces, sizes, strict=True)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every whole text.

    ``n_tokens`` is what the tokenizer of ``path`` gives without added special
    tokens; special strings inside a text are one token each, the library's
    default.  A null text counts as empty (0 and 0).  Null ids, repeated rows
    and texts of any length pass through row by row; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(build_table(frequent_words(docs, text_col), path))
    key = (path, uuid.uuid4().hex)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(key, path, table.value)
        for batch in batches:
            bytes_, tokens = [], []
            for text in batch.column(1).to_pylist():
                bytes_.append(len(text.encode()) if text else 0)
                tokens.append(look.count(text) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {narrow.schema['_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counted = narrow.mapInArrow(count, schema)
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
