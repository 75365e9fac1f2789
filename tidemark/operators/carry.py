"""Folds that no window function can say: what a row gives depends on what the row before gave."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def carried(rows: DataFrame, key: Sequence[str], order: Sequence[str], inputs: Sequence[str], out: str, start: Callable[[], Any], step: Callable) -> DataFrame:
    """rows with the columns `out` (DDL) from a fold over each key's rows in order: step(state, *inputs) gives the next state and the row's values.

    Spark shuffles by key and sorts with spilling; a task streams its sorted rows in Arrow batches and holds one key's state. Rows
    without a key are a key of their own.
    """
    made = T._parse_datatype_string(out)
    schema = T.StructType([*rows.schema.fields, *made.fields])
    kinds = [f.type for f in to_arrow_schema(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start()
        for batch in batches:
            of = lambda names: [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            values = []
            for k, x in zip(zip(*of(key), strict=True), zip(*of(inputs), strict=True), strict=True):
                if k != now:
                    now, state = k, start()
                state, v = step(state, *x)
                values.append(v)
            columns = zip(*values, strict=True) if values else [[]] * len(kinds)
            made_ = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made_], names=schema.names)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
