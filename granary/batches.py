"""Rows through Python a slice at a time: a worker holds the objects of one slice, however large the batches are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of Arrow data that are Python objects at a time; as such they take some twenty times as much.  A longer row is a slice by itself.
SLICE_BYTES = 256 << 10


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Halves, until a slice has ``most`` bytes at most or one row."""
    stack = [batch] if batch.num_rows else []
    while stack:
        part = stack.pop()
        if part.num_rows == 1 or part.nbytes <= most:
            yield part
        else:
            half = part.num_rows // 2
            stack += [part.slice(half), part.slice(0, half)]


def through(rows: Callable[[dict], Iterator[tuple]], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``rows`` makes of each row, a batch for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [r for row in part.to_pylist() for r in rows(row)]
                columns = list(zip(*made, strict=True)) or [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def map_rows(df: DataFrame, rows: Callable[[dict], Iterator[tuple]], ddl: str) -> DataFrame:
    """``rows`` makes any number of rows of each; a value of a map type is a list of pairs."""
    schema = StructType.fromDDL(ddl)
    return df.mapInArrow(through(rows, to_arrow_schema(schema)), schema)
