"""Helpers for the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Rows that a function gets at a time: what it builds in Python stays small beside the batch.
SLICE_ROWS = 1024


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, b"" for null."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` of a function that turns a slice of a batch into columns by name (None: no rows)."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, types = kind.names, to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                if (out := f(batch.slice(at, SLICE_ROWS))) is None:
                    continue
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) and x.type == types.field(n).type else (x.cast(types.field(n).type) if isinstance(x, pa.Array) else pa.array(x, types.field(n).type)) for n in names], schema=types)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, kind)
