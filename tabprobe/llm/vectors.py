"""Tables of vectors: which rows take part, and sums over all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums of tasks that one task adds up.
SUMS_AT_ONCE = 64


def finite(column: str):
    """Whether every component is there and finite; null for a null vector."""
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))


def matrix_of(batch: pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    """The vectors of a batch, which are of one length, as rows of doubles."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def added_up(rows: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray],
             kind: type) -> np.ndarray | None:
    """Sum over all rows of what `of_batch` gives for each batch; None where there are no rows.

    Every task sends one array of its own sum. Those are added up in groups of SUMS_AT_ONCE, and
    their sums again, until one group is left: what reaches the driver does not grow with the
    number of tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total.astype(kind).tobytes()], pa.binary())], names=["total"])

    def together(table: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(b.as_buffer(), kind) for b in table.column("total")]
        return pa.table({"total": pa.array([np.sum(arrays, axis=0, dtype=kind).tobytes()],
                                           pa.binary())})

    sums = rows.mapInArrow(partial, "total binary")
    left = rows.rdd.getNumPartitions()
    while left > SUMS_AT_ONCE:
        left = -(-left // SUMS_AT_ONCE)
        sums = sums.groupBy(F.pmod(F.xxhash64("total"), F.lit(left))).applyInArrow(
            together, "total binary")
    found = sums.toArrow()
    return np.frombuffer(together(found).column("total")[0].as_buffer(), kind) \
        if found.num_rows else None
