"""Tables of a few rows, one per shard, pool, offer or pin, as constants of an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 4_096


def constants(table: DataFrame, *columns: str) -> Column:
    """The rows as an array of structs; more than ``MOST`` are refused.

    A row that ranks or searches them does so inside itself: no join, no shuffle.
    """
    kept = table.select(*columns)
    rows = kept.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} rows: join them instead")
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    kind = kept.schema.simpleString()
    if not rows:
        return F.array().cast(f"array<{kind}>")
    return F.array(*(F.struct(*(F.lit(r[c]).cast(kinds[c]).alias(c) for c in columns)) for r in rows))
