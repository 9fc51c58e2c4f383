"""Operators that judge or number single documents."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import packing, secrets, sharding, token_counts, warc
from deltaloom.llm.scratch import Scratch


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100, 1000, 65_537])
def test_permutation_is_one_to_one_and_invertible(n):
    x = np.arange(n)
    p = sharding.permute(x, n, 7)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, 7, inverse=True) == x).all()
    for row in {0, n // 2, n - 1}:
        shard, slot = sharding.locate(row, n, 8, 7)
        assert sharding.row_at(shard, slot, n, 8, 7) == row


def test_shards_of_edge_rows(edge, edge_rows, empty):
    rows = sharding.shard_rows(edge).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sorted(r.row_no for r in rows) == list(range(len(rows)))
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.row_no)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sharding.shard_rows(empty).count() == 0


def test_shards_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = lambda df: {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df).collect()}
    assert place(docs) == place(docs.repartition(7, F.rand(3)))


def test_token_counts(edge, edge_rows, empty, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = token_counts.load_tokenizer(path)
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    rows = token_counts.count_tokens(edge, path).collect()
    assert Counter(map(tuple, rows)) == Counter((i, len((t or "").encode()), count(t), count(t) > 512) for i, t in edge_rows)
    assert token_counts.count_tokens(empty, path).count() == 0
    # Without a table and with a cache that overflows at once, the counts are the same.
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    look = token_counts.Lookup(tok, token_counts.PackedTable({}))
    for _, t in edge_rows[:8]:
        assert look.count(t or "") == count(t)


def test_packed_table_round_trip():
    items = {"a": 1, " é": 2, "": 0, "long" * 90: 300}
    assert token_counts.PackedTable(items).unpack() == items


KEYS = "|".join("".join(f"[{c.upper()}{c}]" for c in k) for k in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def entropy_peak(run, cls):
    if len(run) < cls.window:
        return 0.0
    best = 0.0
    for i in range(len(run) - cls.window + 1):
        c = Counter(run[i : i + cls.window])
        best = max(best, -sum(n / cls.window * np.log2(n / cls.window) for n in c.values()))
    return best


def all_spans(text):
    found = base_spans(text)
    for k, cls in enumerate(secrets.CLASSES):
        for m in re.finditer(cls.run, text):
            allowed = any(re.search(p, m[0]) for p in secrets.ALLOW)
            if not allowed and entropy_peak(m[0], cls) >= cls.bits:
                found.append((m.start(), 3 + k, m.end()))
    return sorted(found)


SECRET_TEXTS = [
    "token=token:abcdefgh", "PassWord : 'abcdef' x", "api_key==abcdefg apikey=short", "AKIA" + "A" * 16 + " AKIAAKIAB AKIA" + "B1" * 40, "ü😀secret=äbcdefgh secret='zyxwvu' é" * 30,
    "deadbeef" * 5, hashlib.sha256(b"k").hexdigest(), "dGhpcyBpcyBhIHNlY3JldCBrZXkgd2l0aCBlbnRyb3B5QkM5Nzg", "123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789", "x" * 3000, "token=abcdef " * 700,
    "qW3eR5tY7uI9oP1aS2dF4gH6jK8lZ0xCvBnM", None, "",
]


def test_secret_scan(spark, edge, edge_rows, empty):
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(SECRET_TEXTS)], "doc_id long, text string")
    rows = secrets.scan(edge.select("doc_id", "text").unionByName(extra)).collect()
    texts = edge_rows + [(100 + k, t) for k, t in enumerate(SECRET_TEXTS)]
    want = Counter((i, tuple(all_spans(t or ""))) for i, t in texts)
    assert Counter((r.doc_id, tuple((s.start, s.rank, s.end) for s in r.found)) for r in rows) == want
    assert any(r.found and max(s.rank for s in r.found) > 2 for r in rows)
    assert secrets.scan(empty).count() == 0


def test_redaction_keeps_the_rest(spark, edge):
    docs = spark.createDataFrame([(1, "ü password=abcdef, AKIA" + "Z9" * 9 + " end", 9), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert got == {1: ("ü [assign], [access] end", 24), 2: ("clean", 5), 3: (None, None)}
    assert secrets.redact(edge).columns == edge.columns and secrets.redact(edge).count() == edge.count()


def test_archive_round_trip(spark):
    rows = [(5, "http://a/x", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (4, None, None), (9, "http://c\r\nX: 1", ""), (3, "http://b", "<p>same</p>"), (None, "http://d", "<p>same</p>"), (7, "http://e", "ü" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter(map(tuple, warc.archive_and_read(pages).collect()))

    def digest(t):
        import base64

        return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()

    size = lambda t: len((t or "").encode())
    want = Counter()
    for (i, _, t), kind, to in zip(rows, ["revisit", "response", "response", "revisit", "revisit", "revisit", "response"], [3, None, None, 4, 3, 3, None], strict=True):
        want[(i, size(t), digest(t), kind, to)] += 1
    assert got == want
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_records_come_back_byte_for_byte(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>ä</p>"), (2, "http://b", "<p>ä</p>"), (3, "http://c", "")], "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    warc.write_archive(pages, scratch)
    assert spark.read.parquet(f"{scratch.root}/payloads").count() == 2
    for r in warc.read_records(spark, scratch.root).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest == block + b"\r\n\r\n"
        body = block.partition(b"\r\n\r\n")[2]
        assert body == (b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r.payload))


def test_index_is_read_from_the_records(spark):
    rows = [(1, "", "a\r\n\r\nb" * 3), (2, "http://я/РР", "x" * 200_000), (3, "http://c\r\nX: 1", None), (None, None, "ü"), (5, "http://" + "я" * 900, "ü"), (5, "", "ü")]
    pages = spark.createDataFrame([(*r, "z", "z", "z", "z", "z") for r in rows], "page_id long, url string, html string, payload string, key string, header string, id string, size string")
    scratch = Scratch(spark, "test")
    warc.write_archive(pages.repartition(3), scratch)
    got = warc.read_index(spark, scratch.root).collect()
    assert all(r.verified for r in got)
    size = lambda t: len((t or "").encode())
    assert Counter((r.id, r.url, r.payload_bytes) for r in got) == Counter((None if i is None else str(i), u, size(t)) for i, u, t in rows)
    assert Counter(r.record_type for r in got) == {"response": 4, "revisit": 2}
    # A payload that was changed where it is stored is not read back.
    bad = spark.read.parquet(f"{scratch.root}/payloads").selectExpr("key", "CASE WHEN payload = encode('ü', 'UTF-8') THEN encode('u', 'UTF-8') ELSE payload END AS payload")
    bad.write.parquet(f"{scratch.root}/bad")
    scratch.drop("payloads")
    spark.read.parquet(f"{scratch.root}/bad").write.parquet(f"{scratch.root}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_index(spark, scratch.root).collect()


def test_packing(edge, edge_rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.load_tokenizer(path)
    rows = packing.pack(edge, path).collect()
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")) for i, t in edge_rows]
    want = Counter((i, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes()), len(x)) for i, x in ids for a in range(0, len(x), 4096))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0


def test_placements_fill_and_cover():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(rng.integers(1, 65, 5000).tolist()))
    placed = packing.place_lengths(histogram, 64)
    used = Counter()
    for length, _, n, first, offset in placed:
        for s in range(first, first + n):
            assert used[s] == offset
            used[s] += length
    assert max(used.values()) <= 64 and sum(used.values()) == sum(k * v for k, v in histogram.items())
    assert sum(used.values()) / (64 * len(used)) > 0.97
    for length, n in histogram.items():
        ranks = sorted((r, c) for x, r, c, *_ in placed if x == length)
        assert sum(c for _, c in ranks) == n and all(a + b == c for (a, b), (c, _) in zip(ranks, ranks[1:], strict=False))


def test_word_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    tok = packing.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = packing.WordIds(tok)
    text = "Don't stop, the quick  brown\tfox; ÉCOLE 2024! Σας ok <|endoftext|>x"
    for _ in range(2):
        assert words.ids(text) == words.encode(text)
