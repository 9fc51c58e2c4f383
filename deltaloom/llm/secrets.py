"""Secret scans with built-in expressions alone.

Three base rules (assignments, access keys, long hex runs) and, on top of
them, sliding-window Shannon entropy: candidate strings are the maximal runs of
a character class; a window slides over each, its entropy kept up to date from
the counts of the character that enters and the one that leaves.  A candidate
with a window at or over the class's threshold is a span unless an allow-list
pattern matches it.  A map over rows: no shuffle, so no row can be skewed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CharClass:
    name: str
    alphabet: str
    run: str
    window: int
    bits: float


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", r"[0-9a-fA-F]{20,}", 20, 3.2),
    CharClass("entropy_base64", _LOWER + _UPPER + _DIGITS + "+/_=-", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.95),
)
#: Runs that look random but are known not to be secret: counting sequences,
#: UUIDs, placeholder words, one short block over and over.
ALLOW = (
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|xxxxxx|dummy|redacted",
    r"^(.{1,6}?)\1{3,}.{0,6}$",
)

# The base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
#: A maximal run of 20 or 24 characters is the leftmost match of the bounded
#: repeat, so the length test can sit in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

_ASSIGN_GATE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_LONG_RUN_GATE = r"[A-Za-z0-9+/_=-]{20}"
_BLOCK = 256
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(xs: Column) -> Column:
    """Sum of what stands before each element; in blocks, so that long arrays stay near linear."""

    def running(part: Column, start: Column) -> Column:
        init = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(part, init, step, lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))
    starts = running(F.transform(blocks, _sum), F.lit(0).cast("long"))
    nested = F.zip_with(blocks, starts, running)
    return F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(nested))


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s).cast("long"))


def _entropy_peak(run: Column, cls: CharClass) -> Column:
    """Highest entropy, in bits, of any window of the run."""

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    w = cls.window

    def slide(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            came = F.element_at(codes, i)
            left = F.when(i > w, F.element_at(codes, F.greatest(i - w, F.lit(1)))).otherwise(F.lit(0))
            counts = F.transform(acc["counts"], lambda n, k: n + (k + 1 == came).cast("int") - (k + 1 == left).cast("int"))
            n_in, n_out = F.element_at(acc["counts"], came), F.element_at(acc["counts"], F.greatest(left, F.lit(1)))
            grown = acc["s"] + F.when(came == left, F.lit(0.0)).otherwise(
                term(n_in + 1) - term(n_in) + F.when(left > 0, term(n_out - 1) - term(n_out)).otherwise(F.lit(0.0))
            )
            entropy = F.log2(F.lit(float(w))) - grown / w
            best = F.when(i >= w, F.greatest(acc["best"], entropy)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), grown.alias("s"), best.alias("best"))

        zero = F.struct(
            F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best")
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda a: a["best"])

    # One-element transform: binds the codes once instead of once per step.
    return F.element_at(F.transform(F.array(codes), slide), 1)


def _allowed(run: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | run.rlike(pattern)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``: array of (start, rank, end, kind), sorted; offsets in code points, end exclusive.

    ``rank`` is the kind's place in :data:`KINDS`.  Null and empty texts have
    no span; null ids and repeated rows pass through row by row; an empty
    table gives an empty result; other columns are not read.
    """
    none = F.array().cast("array<string>")
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    gated = base.select("*", F.col("_t").rlike(_ASSIGN_GATE).alias("_g0"), F.col("_t").rlike(_LONG_RUN_GATE).alias("_g1"))
    rules = [("assign", ASSIGN, "_g0"), ("access", ACCESS, "_g1"), ("hex", HEX, "_g1"), *((c.name, c.run, "_g1") for c in CLASSES)]
    cut = gated.select(
        "_id",
        *(F.when(F.col(g), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(none).alias(f"_m_{k}") for k, p, g in rules),
        *(F.when(F.col(g), F.split("_t", p, -1)).otherwise(none).alias(f"_p_{k}") for k, p, g in rules),
        F.when(F.col("_g0"), _lengths(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)))).alias("_v"),
    )
    placed = cut.select(
        "_id", "_v", *(f"_m_{k}" for k, *_ in rules), *(prefix_sums(F.zip_with(_lengths(F.col(f"_p_{k}")), _lengths(F.col(f"_m_{k}")), lambda a, b: a + F.coalesce(b, F.lit(0).cast("long")))).alias(f"_s_{k}") for k, *_ in rules),
        *(_lengths(F.col(f"_p_{k}")).alias(f"_q_{k}") for k, *_ in rules),
    )

    def spans(kind: str, keep) -> Column:
        m = F.col(f"_m_{kind}")
        rows = F.transform(
            m,
            lambda s, i: F.struct(
                (F.element_at(F.col(f"_s_{kind}"), i + 1) + F.element_at(F.col(f"_q_{kind}"), i + 1)).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (F.element_at(F.col(f"_s_{kind}"), i + 1) + F.element_at(F.col(f"_q_{kind}"), i + 1) + F.length(s)).alias("end"),
                F.lit(kind).alias("kind"),
                keep(s, i).alias("keep"),
            ),
        )
        kept = F.filter(rows, lambda r: r["keep"])
        return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["rank"].alias("rank"), r["end"].alias("end"), r["kind"].alias("kind")))

    every = [
        spans("assign", lambda s, i: F.element_at(F.col("_v"), i + 1) >= ASSIGN_VALUE),
        spans("access", lambda s, i: F.lit(True)),
        spans("hex", lambda s, i: F.lit(True)),
        *(spans(c.name, lambda s, i, c=c: ~_allowed(s) & (_entropy_peak(s, c) >= c.bits)) for c in CLASSES),
    ]
    return placed.select(F.col("_id").alias(id_col), F.sort_array(F.concat(*every)).alias("found"))


def _spans_column(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``docs``, boxed, with the text and its spans."""
    boxed = docs.select(F.struct(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).alias("_box"), F.col(text_col).alias("_text"))
    return scan(boxed, "_box", "_text").select("_box.row", "_box.body", "found")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's characters replaced by ``[kind]``; overlapping spans are one, named by the first.

    Texts without a span, nulls and empty ones among them, stay as they are, and
    very long ones are scanned whole; repeated rows are redacted each; an empty
    table stays empty; other columns pass through, whatever their names, but a
    column ``n_chars`` is kept in step with a changed text.
    """
    found = _spans_column(docs, text_col)
    # Runs of overlapping spans: (start, end, kind) each, in order.
    empty = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    last = lambda a: F.element_at(a, -1)

    def merge(a: Column, r: Column) -> Column:
        fresh = F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"))
        joined = F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], r["end"]).alias("end"), last(a)["kind"].alias("kind"))
        overlaps = (F.size(a) > 0) & (r["start"] < F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0).cast("long")))
        return F.when(overlaps, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(fresh)))

    runs = found.select("row", "body", F.when(F.size("found") > 0, F.aggregate("found", empty, merge)).otherwise(empty).alias("runs"))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(F.col("runs"), F.greatest(i, F.lit(1)))["end"])
    pieces = F.transform("runs", lambda r, i: F.concat(F.substring("body", (before(i) + 1).cast("int"), (r["start"] - before(i)).cast("int")), F.lit("["), r["kind"], F.lit("]")))
    tail = F.substring("body", (last(F.col("runs"))["end"] + 1).cast("int"), F.length("body"))
    changed = F.when(F.size("runs") > 0, F.concat(F.array_join(pieces, ""), tail))
    named = runs.select("row", changed.alias("changed"))
    out = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == text_col:
            own = F.coalesce("changed", own)
        elif c == "n_chars":
            own = F.when(F.col("changed").isNotNull(), F.length("changed").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return named.select(*out)


def _text_of(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda r: r["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_text_of(F.filter("found", lambda r: r["rank"] < 3)), 256).alias("base_sha256"),
        _text_of(F.col("found")).alias("spans"),
    )
