"""Folds over the rows of a key in order, where every step needs the outcome of the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(rows: DataFrame, by: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Callable[[Any, dict], Iterable[tuple]], end: Callable[[Any], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """``by`` columns and what ``step`` and ``end`` give, per key, in the order of ``order``.

    One shuffle by key and a sort; rows stream through, a key's state is all
    that is held.  ``step(state, row)`` changes the state.
    """
    kind = StructType([rows.schema[c] for c in by] + _parse_datatype_string(schema).fields)
    wide = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def emit(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(wide)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in by)
                if state is None or own != key:
                    if state is not None:
                        out += ((*key, *r) for r in end(state))
                    key, state = own, start()
                out += ((*key, *r) for r in step(state, row))
            yield emit(out)
        if state is not None:
            yield emit([(*key, *r) for r in end(state)])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kind)
