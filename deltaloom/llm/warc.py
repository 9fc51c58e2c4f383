"""Content-addressed web archive.

A record is stored in two tables: ``payloads`` holds every distinct payload
once under its SHA-256, ``headers`` the exact header bytes of every record (the
archive header and, in it, the HTTP header) with the key of its payload.
:func:`read_records` joins them back into the records as they would stand in a
``.warc`` file, a payload moving to its responses alone; :func:`read_index`
parses those records and nothing else.  All is verified on the way back: the
stored bytes must give the key again, the payload cut out of a record the SHA-1
and the length that its header took from the record's own payload, and a revisit
must name a response of the same digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

DATE = "2024-01-01T00:00:00Z"
HTTP_TYPE = "text/html; charset=utf-8"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1; 160 bits make exactly 32 characters."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _has_line_end(text: Column) -> Column:
    """A header value cannot hold line ends; an address with one is kept in base64."""
    return F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\n"))


def write_archive(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes ``headers`` and ``payloads`` into the scratch folder.

    Of the records with equal payloads of ``min_bytes`` bytes at least, the one
    with the smallest id (null ids last) is the response and the others revisit
    it; repeated rows count as records of their own.  A null body is an empty
    payload; very long ones are stored whole; other columns are not read.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    facts = rows.select(
        "id", "url", F.sha2("payload", 256).alias("key"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("seq")
    )
    facts = scratch.write(facts, "facts")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "seq")
    owners = scratch.write(facts.filter(F.col("bytes") >= min_bytes).groupBy("key").agg(F.min(place).alias("owner")), "owners")
    joined = facts.join(owners.withColumnRenamed("key", "owner_key"), (F.col("key") == F.col("owner_key")) & (F.col("bytes") >= min_bytes), "left")
    revisit = F.coalesce(F.col("owner.seq") != F.col("seq"), F.lit(False))
    urn = lambda i, s: _urn(F.concat_ws("/", i.cast("string"), s.cast("string")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {HTTP_TYPE}\r\n"), _line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), urn(F.col("id"), F.col("seq")), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.when(~_has_line_end(F.col("url")), F.col("url"))),
        _line("X-Target-URI-Base64", F.when(_has_line_end(F.col("url")), F.replace(F.base64(F.encode("url", "UTF-8")), F.lit("\r\n"), F.lit("")))),
        _line("X-Page-Id", F.col("id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), urn(F.col("owner.id"), F.col("owner.seq")), F.lit(">"))),
                _line("X-Refers-To-Page-Id", F.col("owner.id").cast("string")),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    scratch.write(joined.select(head.cast("binary").alias("header"), F.col("key").alias("payload_key"), F.lit(kind).alias("id_type")), "headers")
    # Copies of one scan partition meet before the shuffle, so a group of
    # copies moves one payload per partition at most.
    once = rows.groupBy(F.sha2("payload", 256).alias("key")).agg(F.first("payload").alias("payload"))
    scratch.write(once, "payloads")
    scratch.drop("facts", "owners")


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/headers"), spark.read.parquet(f"{root}/payloads")


def _field(text: Column, name: str) -> Column:
    """A header line's value; null where there is no such line."""
    return F.when(F.contains(text, F.lit(f"\n{name}: ")), F.regexp_extract(text, rf"\n{name}: ([^\r\n]*)\r\n", 1))


def _is_revisit(header: Column) -> Column:
    return _field(header.cast("string"), "WARC-Type") == "revisit"


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """``record``: header, payload (a response's) and closing line ends, byte for byte; ``payload``: a response's.

    Only responses meet the payloads, one each unless small payloads are all
    responses; a revisit has none in its record.  A stored payload that does not
    give its key again fails the read.
    """
    headers, payloads = _tables(spark, root)
    end = F.lit(b"\r\n\r\n")
    sound = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.lit("stored payload does not match its key")))
    full = headers.filter(~_is_revisit(F.col("header"))).join(payloads.select("key", sound.alias("payload")), F.col("payload_key") == F.col("key"))
    again = headers.filter(_is_revisit(F.col("header")))
    whole = full.select("payload", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(again.select(F.lit(None).cast("binary").alias("payload"), F.concat("header", end).alias("record")))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per record: id, url, payload_bytes, payload_digest, record_type, refers_to, verified; parsed from the records.

    A response's size and digest are computed from the payload in its record, a
    revisit's come from the response that it refers to, as narrow facts.
    """
    mark = F.lit(b"\r\n\r\n")
    size = F.octet_length("record")
    # Header of the archive, header of the protocol, payload, closing line ends.
    blank = F.lit("\r\n\r\n")
    head = F.substring(F.col("record"), F.lit(1), F.instr(F.decode("record", "ISO-8859-1"), blank) + 1).cast("string")  # one character per byte
    rows = read_records(spark, root).select(head.alias("h"), "record", size.alias("size"))
    said = _field(F.col("h"), "Content-Length").cast("long")
    block = F.substring(F.col("record"), (F.col("size") - 4 - said + 1).cast("int"), said.cast("int"))
    kind = _field(F.col("h"), "WARC-Type")
    parsed = rows.select(
        _field(F.col("h"), "X-Page-Id").alias("id"),
        F.coalesce(F.decode(F.unbase64(_field(F.col("h"), "X-Target-URI-Base64")), "UTF-8"), _field(F.col("h"), "WARC-Target-URI")).alias("url"),
        kind.alias("record_type"),
        _field(F.col("h"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("h"), "WARC-Refers-To").alias("target"),
        _field(F.col("h"), "X-Refers-To-Page-Id").alias("refers_to"),
        F.substring_index(_field(F.col("h"), "WARC-Payload-Digest"), ":", -1).alias("said"),
        ((F.octet_length(F.encode("h", "UTF-8")) + 2 + said + 4 == F.col("size")) & (F.substring(F.col("record"), -4, 4) == mark)).alias("framed"),
        block.alias("block"),
    )
    # The protocol's header is short: it ends in the block's first bytes.
    lead = F.instr(F.decode(F.substring(F.col("block"), 1, 1_024), "ISO-8859-1"), blank)
    cut = parsed.withColumn("http", F.substring(F.col("block"), F.lit(1), lead + 1).cast("string")).withColumn("body", F.substring(F.col("block"), lead + 4, F.octet_length("block")))
    length = _field(F.col("http"), "Content-Length").cast("long")
    narrow = cut.select(
        "id", "url", "record_type", "record_id", "target", "refers_to", "said", "framed", length.alias("length"),
        F.when(F.col("record_type") == "response", F.octet_length("body").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "response", base32_sha1(F.col("body"))).alias("payload_digest"),
    )
    narrow = Scratch(spark, "warcindex").write(narrow, "index")
    true = narrow.filter("record_type = 'response'")
    own = true.select("id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("framed") & (F.col("said") == F.col("payload_digest")) & (F.col("length") == F.col("payload_bytes"))).alias("verified"))
    known = true.select(F.col("record_id").alias("_target"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    again = narrow.filter("record_type = 'revisit'").join(known, F.col("target") == F.col("_target"), "left")
    agree = F.coalesce(F.col("framed") & (F.col("said") == F.col("d")) & (F.col("length") == F.col("b")), F.lit(False))
    return own.unionByName(again.select("id", "url", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to", agree.alias("verified")))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Writes the archive and reads its index back; fails if a stored payload does not match its digest.

    Null bodies are empty payloads, very long ones are stored whole, repeated
    rows are records of their own, a null id or address has no header line and
    reads back as null; an empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archive(pages, scratch, id_col=id_col, **columns)
    kind = pages.schema[id_col].dataType
    rows = read_index(spark, scratch.root)
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("stored payload does not match its digest")))
    return rows.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", checked.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_GROUPS = " || ".join(
    "(" + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INT), 1)" for i in range(8)) + ")" for g in range(4)
)
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM f
"""
