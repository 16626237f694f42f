"""Arrow batches for the operators that run Python: whole texts, bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes that one step works on at a time, unless one text is larger.
CHUNK_BYTES = 1 << 20


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of ``column``, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def map_chunks(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], dict], most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over chunks; ``work`` gives the columns of ``schema``, in its order, for one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text, most):
            out = work(chunk)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, from_pandas=False) for x in out.values()], names=list(out)
            )

    return df.mapInArrow(run, schema)
