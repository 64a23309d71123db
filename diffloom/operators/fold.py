"""Folds over rows in order within a key, without gathering a key's rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def folded(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: object, step: Callable, name: str, kind: str) -> DataFrame:
    """``df`` with column ``name``: what ``step(state, *inputs)`` gives beside the next state, row by row.

    Rows are moved to the task of their key and sorted there; the fold walks over the sorted batches and holds one state
    at a time, so a key with any number of rows takes constant memory and linear time. Null keys are one key. ``kind`` is
    int, bigint or boolean.
    """
    columns = df.columns

    def run(batches):
        last, state = object(), start
        for b in batches:
            out = []
            given = zip(*(b.column(c).to_pylist() for c in inputs))
            for key, x in zip(zip(*(b.column(c).to_pylist() for c in keys)), given):
                if key != last:
                    last, state = key, start
                state, value = step(state, *x)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, _ARROW[kind])], names=[*columns, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, {"int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}[kind])])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
