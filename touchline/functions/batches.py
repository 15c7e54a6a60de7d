"""Columns computed by a Python function on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def append_batchwise(
    df: DataFrame, argument: Column, outputs: T.StructType, use: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """Add the columns ``use`` computes from ``argument``; all other columns pass through as Arrow data untouched."""
    staged = df.withColumn("_argument", argument)
    schema = T.StructType([*df.schema.fields, *outputs.fields])
    arrow_types = [f.type for f in to_arrow_schema(outputs)]
    names = [*df.columns, *outputs.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [a.cast(t) for a, t in zip(use(batch.column(batch.num_columns - 1)), arrow_types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return staged.mapInArrow(run, schema)
