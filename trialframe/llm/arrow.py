"""Row-wise work on texts in Arrow batches.

Rows pass through with all their columns, so nothing is joined back by a key that
may be NULL or repeated. Batches are cut by bytes: a task holds at most
``PIECE_BYTES`` of text, or one text where that alone is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PIECE_BYTES = 1 << 20

#: Makes the worker's function from the text columns to the new columns.
Maker = Callable[[], Callable[..., Sequence]]


def pieces(batch: pa.RecordBatch, columns: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose given columns hold about PIECE_BYTES at most."""
    weights = sum(_lengths(batch.column(i)) for i in columns)
    start = held = 0
    for row, weight in enumerate(weights):
        if held and held + weight > PIECE_BYTES:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(weight)
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array):
    import numpy as np
    import pyarrow.compute as pc

    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype("int64") * 8 + 8
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype("int64") + 8


def append_columns(
    df: DataFrame, inputs: Sequence[str], new: Sequence[T.StructField], make: Maker,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The kept columns (default: all) followed by ``new``, computed from ``inputs``.

    ``make()`` runs once in each task; its function takes one list for each input
    column and returns one sequence for each new column. A kept column whose name
    clashes with a new one gives way to it.
    """
    fresh = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in fresh and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *new])
    n, k = len(kept), len(inputs)
    source = df.select(
        *[F.col(f"`{f.name}`") for f in kept],
        *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        work = make()
        for whole in batches:
            for batch in pieces(whole, range(n, n + k)):
                out = work(*[batch.column(n + i).to_pylist() for i in range(k)])
                arrays = [batch.column(i) for i in range(n)]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, kinds.field(n + i).type) for i, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return source.mapInArrow(run, schema)
