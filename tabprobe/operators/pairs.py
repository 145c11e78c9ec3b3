"""Co-occurrence of bins and sums of an outcome for all pairs of columns, in one pass.

The bins of a row are a 0/1 vector; the Gram matrix of those vectors counts how often two bins meet,
and the same matrix weighted by the outcome and by its square sums both up. A task adds the
matrices of its batches and sends their entries, which are summed over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of Gram matrices that a task holds before it sends them on.
HELD_ENTRIES = 4_000_000
#: Rows whose 0/1 vectors are expanded at once, and columns of a block of the matrix.
ROWS_AT_ONCE, BLOCK = 2_048, 512
_ENTRY = ["a", "b", "bin_a", "bin_b", "n", "total", "squares"]


def pair_cells(rows: DataFrame, group: str, bins: str, y: str, q: int) -> DataFrame:
    """Per group, pair of columns a < b and pair of bins: rows, sum and sum of squares of `y`.

    `bins` is an array with the bin (1 to q) of each column, null where a row has none; `y` a
    double; a row without it is left out. All pairs of positions in the array are covered:
    (group, a, b, bin_a, bin_b, n, total, squares).
    """
    dtype = rows.schema[group].dataType.simpleString()

    def sent(group_value, kind, blocks: dict) -> Iterator[pa.RecordBatch]:
        for (i, j), (n, total, squares) in blocks.items():
            left, right = np.nonzero(n)
            one, other = left + i, right + j
            keep = one // q < other // q
            left, right, one, other = left[keep], right[keep], one[keep], other[keep]
            if len(left):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group_value] * len(left), kind), pa.array((one // q).astype(np.int32)),
                     pa.array((other // q).astype(np.int32)),
                     pa.array((one % q + 1).astype(np.int32)),
                     pa.array((other % q + 1).astype(np.int32)),
                     pa.array(n[left, right].astype(np.int64)), pa.array(total[left, right]),
                     pa.array(squares[left, right])], names=[group, *_ENTRY])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        entries = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kind = table.schema.field(group).type
            for value in table.column(group).unique().to_pylist():
                mask = pc.equal(table.column(group), pa.scalar(value, kind))
                own = table.filter(mask if value is not None else table.column(group).is_null())
                lists = own.column(bins).combine_chunks()
                width = len(lists[0]) if len(lists) else 0
                if not width:
                    continue
                codes = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
                codes = codes.reshape(len(own), width).astype(np.int64)
                outcome = own.column(y).to_numpy().astype(float)
                state = held.setdefault(value, {})
                for start in range(0, len(own), ROWS_AT_ONCE):
                    part, weight = codes[start:start + ROWS_AT_ONCE], outcome[start:start + ROWS_AT_ONCE]
                    full = np.zeros((len(part), width * q))
                    row, column = np.nonzero(part)
                    full[row, column * q + part[row, column] - 1] = 1.0
                    weighted = full * weight[:, None]
                    twice = weighted * weight[:, None]
                    for i in range(0, width * q, BLOCK):
                        for j in range(i, width * q, BLOCK):
                            left = full[:, i:i + BLOCK].T
                            found = [left @ m[:, j:j + BLOCK] for m in (full, weighted, twice)]
                            if (i, j) in state:
                                for total, more in zip(state[i, j], found):
                                    total += more
                            else:
                                state[i, j] = found
                                entries += 3 * found[0].size
                    if entries > HELD_ENTRIES:
                        for name, blocks in held.items():
                            yield from sent(name, kind, blocks)
                        held, entries = {}, 0
                        state = held.setdefault(value, {})
        for name, blocks in held.items():
            yield from sent(name, kind, blocks)

    schema = (f"`{group}` {dtype}, a int, b int, bin_a int, bin_b int, n long, total double, "
              "squares double")
    found = rows.where(F.col(y).isNotNull()).select(group, bins, y).mapInArrow(summed, schema)
    return found.groupBy(group, *_ENTRY[:4]).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def xor_effects(df: DataFrame, outcome: Column, bits: list[Column], centre: float) -> DataFrame:
    """Cohen's d of the outcome by the XOR of each pair of 0/1 columns: (a, b, d), one scan.

    `centre` is near the outcome's mean; sums of squares are taken around it.
    """
    rows = df.select(F.lit(0).alias("all"), F.array(*[b + 1 for b in bits]).alias("bins"),
                     (outcome - F.lit(centre)).alias("y"))
    cells = pair_cells(rows, "all", "bins", "y", 2)
    one = F.col("bin_a") != F.col("bin_b")
    sums = cells.groupBy("a", "b").agg(*[
        F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).alias(f"{c}{bit}")
        for bit, test in ((1, one), (0, ~one)) for c in ("n", "total", "squares")])

    def apart(bit: int) -> Column:
        n, total = F.col(f"n{bit}"), F.col(f"total{bit}")
        return F.greatest(F.col(f"squares{bit}") - total * total / n, F.lit(0.0))

    pooled = F.sqrt((apart(1) + apart(0)) / (F.col("n1") + F.col("n0") - 2))
    gap = F.abs(F.col("total1") / F.col("n1") - F.col("total0") / F.col("n0"))
    d = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), F.coalesce(F.try_divide(gap, pooled)))
    return sums.select("a", "b", F.coalesce(d, F.lit(0.0)).alias("d"))
