"""Column-level operators: row ids, renaming, insertion, and which columns count as features."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.draws import digest_text, shuffled, u_text
from tabprobe.functions.numbers import number_columns, to_double
from tabprobe.sources.shared import cut

# Neutral stems for an inserted indicator column.
NEUTRAL_NAMES = [
    "region", "channel", "segment", "cohort", "tier",
    "variant", "cluster", "period", "quarter", "sample",
    "trial", "run", "split", "bucket", "partition",
    "group", "class", "phase", "batch", "slot",
]
_ROW_BLOCK = 1_000_000
_CLEARLY_MANY = 1000


def unpivot_numbers(
    df: DataFrame, names: list[str], carry: dict[str, Column], value: str = "x"
) -> DataFrame:
    """One row per (row, numeric column): ``(carry..., feature, value)``, nulls left out."""
    rows = df.select(
        *[col.alias(name) for name, col in carry.items()],
        *[to_double(df, n).alias(f"@{n}") for n in names],
    )
    long = rows.unpivot(list(carry), [f"`@{n}`" for n in names], "feature", value)
    return long.where(F.col(value).isNotNull()).withColumn(
        "feature", F.substring("feature", 2, 10_000)
    )


def distinct_reaches(df: DataFrame, wanted: dict[str, int]) -> dict[str, bool]:
    """Whether each column has at least the given (small) number of distinct values.

    A sketch settles the columns that clearly have many; only the rest, whose few values combine
    map-side, are counted exactly.
    """
    names = list(wanted)
    sketch = df.agg(
        *[F.approx_count_distinct(F.col(f"`{n}`"), 0.05).alias(f"c{i}") for i, n in enumerate(names)]
    ).first()
    many = {n: sketch[i] >= max(_CLEARLY_MANY, 10 * wanted[n]) for i, n in enumerate(names)}
    few = [n for n in names if not many[n]]
    if few:
        exact = df.agg(
            *[F.count_distinct(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(few)]
        ).first()
        for i, name in enumerate(few):
            many[name] = exact[i] >= wanted[name]
    return many


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys into tasks of about ``_ROW_BLOCK`` rows each, however many rows there are.

    Keys that follow one another shrink to almost nothing in a shuffle, and partitions that are
    joined by their bytes would then hold any number of them; a number that is asked for is kept.
    """
    parts = max(-(-rows // _ROW_BLOCK),
                int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def held_values(df: DataFrame, value: Column, rows: int) -> DataFrame:
    """Every different value (null too) and how many of the ``rows`` rows hold it: ``(value, n)``."""
    return spread(df.select(value.alias("value")), rows, "value").groupBy("value").agg(
        F.count("*").alias("n"))


def numeric_features(
    df: DataFrame, outcome: str, min_unique: int
) -> list[str]:
    """Numeric columns other than the outcome with at least ``min_unique`` values."""
    names = [n for n in number_columns(df) if n != outcome]
    if not names:
        return []
    reaches = distinct_reaches(df, {n: min_unique for n in names})
    return [n for n in names if reaches[n]]


def falls_along(
    rows: DataFrame, group: str, order: list[str], values: list[str], count: int
) -> DataFrame:
    """Per group: whether each of some double columns ever falls from one row to the next.

    Rows are dealt into ranges of (group, order) whose bounds Spark samples from the rows, about
    ``count / _ROW_BLOCK`` of them, so that ids that lie far apart or close together make ranges
    of like size. A range is read in order once and leaves its first and last row and whether the
    values fell in between, per group; neighbouring ranges are then compared by those edges.
    A row without a value is no step: neither the one to it nor the one from it falls.
    """
    ranges = max(-(-count // _ROW_BLOCK),
                 int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    dtype = rows.schema[group].dataType.simpleString()
    ends = [f"{end}{i}" for i in range(len(values)) for end in ("fell", "first", "last")]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: tuple | None = None  # group, fell, first, last

        def sent(state: tuple) -> pa.RecordBatch:
            own, fell, first, last = state
            cells = [v for i in range(len(values)) for v in (
                pa.array([bool(fell[i])]), pa.array([first[i]], pa.float64(), from_pandas=True),
                pa.array([last[i]], pa.float64(), from_pandas=True))]
            return pa.RecordBatch.from_arrays(
                [pa.array([own], kind), pa.array([here], pa.int32()), *cells],
                names=[group, "range", *ends])

        for batch in batches:
            kind = batch.schema.field(group).type
            x = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values]).astype(float)
            own = batch.column(group)
            starts = [0, *(np.flatnonzero(pc.not_equal(own[1:], own[:-1]).to_numpy(
                zero_copy_only=False)) + 1).tolist()] if len(own) else []
            for start, end in zip(starts, [*starts[1:], len(own)]):
                part, name = x[:, start:end], own[start].as_py()
                fell = (part[:, 1:] < part[:, :-1]).any(axis=1)
                if held is not None and held[0] == name:
                    fell |= held[1] | (part[:, 0] < held[3])
                    held = (name, fell, held[2], part[:, -1])
                    continue
                if held is not None:
                    yield sent(held)
                held = (name, fell, part[:, 0], part[:, -1])
        if held is not None:
            yield sent(held)

    kinds = ", ".join(f"fell{i} boolean, first{i} double, last{i} double"
                      for i in range(len(values)))
    found = dealt.select(group, *values).mapInArrow(edges, f"`{group}` {dtype}, range int, {kinds}")
    along = Window.partitionBy(group).orderBy("range")  # one row per range
    return found.select(group, *[
        (F.col(f"fell{i}") | F.coalesce(
            F.col(f"first{i}") < F.lag(f"last{i}").over(along), F.lit(False))).alias(f"fell{i}")
        for i in range(len(values))
    ]).groupBy(group).agg(*[
        F.bool_or(f"fell{i}").alias(v) for i, v in enumerate(values)
    ])


def has_inversion(df: DataFrame, names: list[str], row_id: str) -> dict[str, bool]:
    """Whether each column ever falls along the row order."""
    rows = df.select(F.lit(0).alias("all"), F.col(f"`{row_id}`").alias("row"), *[
        to_double(df, n).alias(f"v{i}") for i, n in enumerate(names)
    ])
    found = falls_along(
        rows, "all", ["row"], [f"v{i}" for i in range(len(names))], df.count()).first()
    return {n: bool(found and found[f"v{i}"]) for i, n in enumerate(names)}


def id_like(df: DataFrame, names: list[str], row_id: str) -> set[str]:
    """Columns without repeats that never fall along the row order."""
    if not names:
        return set()
    sketch = df.agg(
        *[F.approx_count_distinct(F.col(f"`{n}`"), 0.05).alias(f"c{i}") for i, n in enumerate(names)],
        F.count("*").alias("rows"),
    ).first()
    total = sketch["rows"]
    # A sketch more than a third under the row count rules a column out without a shuffle.
    near = [n for i, n in enumerate(names) if sketch[i] >= total * 2 / 3]
    rising = [n for n, falls in has_inversion(df, near, row_id).items() if not falls] if near else []
    if not rising:
        return set()
    exact = df.agg(
        *[F.count_distinct(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(rising)]
    ).first()
    return {n for i, n in enumerate(rising) if exact[i] == total}


def row_id_column(df: DataFrame) -> str | None:
    """First column that numbers the rows 0..n-1 or 1..n, found without relying on row order."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    def as_long(name: str) -> Column | None:
        dtype = df.schema[name].dataType
        if isinstance(dtype, whole):
            return F.col(f"`{name}`").cast("bigint")
        if isinstance(dtype, (T.StringType, T.DoubleType, T.FloatType)):
            value = F.trim(F.col(f"`{name}`").cast("string")).try_cast("double")
            return F.when(value == F.rint(value), value.try_cast("bigint"))
        return None

    columns = {n: as_long(n) for n in df.columns}
    columns = {n: c for n, c in columns.items() if c is not None}
    if not columns:
        return None
    bounds = df.agg(F.count("*").alias("rows"), *[
        F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(f"s{i}")
        for i, c in enumerate(columns.values())
    ]).first()
    rows = bounds["rows"]
    for i, (name, col) in enumerate(columns.items()):
        s = bounds[f"s{i}"]
        fits = rows > 0 and s["n"] == rows and s["low"] in (0, 1) and s["high"] == s["low"] + rows - 1
        if fits and held_values(df, col, rows).count() == rows:
            return name
    return None


def ensure_row_id(df: DataFrame) -> DataFrame:
    """Rename the column that numbers the rows to ``row_id``, or put a new ``row_id`` first.

    New numbers follow the rows' place in their source, see :func:`number_rows`.
    """
    found = row_id_column(df)
    if found is not None:
        return df.withColumnRenamed(found, "row_id")
    return number_rows(df)


def _places_in_files(df: DataFrame) -> DataFrame | None:
    """Rows with their file and place, or null where a place is unknown or rows were left out."""
    try:
        tagged = df.select(
            "*", F.col("_metadata.file_path").alias("_part"),
            F.col("_metadata.row_index").alias("_at"),
        )
    except AnalysisException:
        return None
    whole = tagged.groupBy("_part").agg(
        (F.count("*") == F.max("_at") + 1).alias("whole")
    ).agg(F.bool_and("whole")).first()[0]
    return None if whole is False else tagged


#: Files or blocks of files that are sent to every task at most.
_BLOCKS_SENT = 100_000


def _blocks_of_files(df: DataFrame) -> DataFrame | None:
    """Rows with their file, the place where their block of it begins, and their place in a task."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    try:
        return df.select(
            "*", F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.spark_partition_id().alias("_part"), inside.alias("_at"))
    except AnalysisException:
        return None


def number_rows(df: DataFrame) -> DataFrame:
    """Put ``row_id`` 1..n first.

    Whole Parquet files are numbered by file and place in the file. Text files (CSV, JSON) are
    numbered by file, block and place in the block: rows are counted by block in one pass, and the
    sums of the blocks before each give its first number. Both are the same on every read, however
    files are cut into blocks, and no second copy of the table is made. Should a later read cut
    the files in another way than the pass that counted (executors came or went in between), it
    ends with an error and not with other numbers; call this again then. Any other table is
    checkpointed first, which fixes its partitions, and numbered by partition and place in the
    partition. No window or sort over rows is needed.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    tagged = _places_in_files(df)
    if tagged is None and (blocks := _blocks_of_files(df)) is not None:
        key = ["_file", "_start", "_part"]
        along = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
        counts = cut(blocks.groupBy(*key).agg(
            F.count("*").alias("_held"), F.min("_at").alias("_first")
        ).withColumn("_ahead", F.coalesce(F.sum("_held").over(along), F.lit(0))))  # row per block
        sent = F.broadcast(counts) if counts.count() <= _BLOCKS_SENT else counts
        place = F.col("_at") - F.col("_first")
        fits = F.coalesce((place >= 0) & (place < F.col("_held")), F.lit(False))
        number = F.when(fits, F.col("_ahead") + place + 1).otherwise(
            F.raise_error(F.lit("files are cut into other blocks than when rows were counted"))
            .cast("bigint"))
        return blocks.join(sent, key, "left").select(number.alias("row_id"), *names)
    if tagged is None:
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
        tagged = cut(df).select("*", F.spark_partition_id().alias("_part"), inside.alias("_at"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tagged.groupBy("_part").agg(F.count("*").alias("_held")).select(
        "_part", F.coalesce(F.sum("_held").over(ahead), F.lit(0)).alias("_ahead")
    )  # one row per file or partition; the join is left to the optimizer, which sees its size
    return tagged.join(parts, "_part").select(
        (F.col("_ahead") + F.col("_at") + 1).alias("row_id"), *names
    )


def derangement(names: list[str], seed: int) -> dict[str, str]:
    """Each name mapped to another one, none to itself, each used once."""
    if len(names) < 2:
        return {}
    mixed = shuffled(names, seed, "derange")
    return dict(zip(mixed, mixed[1:] + mixed[:1]))  # one cycle through all names


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


def derange_columns(
    df: DataFrame, exclude: list[str], seed: int
) -> tuple[DataFrame, dict[str, str]]:
    mapping = derangement([c for c in df.columns if c not in exclude], seed)
    return rename_columns(df, mapping), mapping


def random_names(names: list[str], taken: list[str], seed: int) -> dict[str, str]:
    """A five-letter name of its own for each column."""
    used, mapping = set(taken), {}
    for name in names:
        attempt = 0
        while name not in mapping:
            text = digest_text(seed, f"name{attempt}", name)
            letters = (int(text[2 * i:2 * i + 2], 16) % 26 for i in range(5))
            fresh = "".join(ascii_lowercase[at] for at in letters)
            if fresh not in used:
                used.add(fresh)
                mapping[name] = fresh
            attempt += 1
    return mapping


def anonymize_columns(
    df: DataFrame, keep: list[str], seed: int
) -> tuple[DataFrame, dict[str, str]]:
    kept = [c for c in df.columns if c in keep or c == "row_id"]
    mapping = random_names([c for c in df.columns if c not in kept], kept, seed)
    return rename_columns(df, mapping), mapping


def insertion(columns: list[str], seed: int) -> tuple[str, int]:
    """Name and position of a new indicator column: an unused neutral stem, before the last.

    Where all stems are taken they are numbered: ``region2_flag`` and so on.
    """
    turn = 1
    while True:
        stems = [n if turn == 1 else f"{n}{turn}" for n in NEUTRAL_NAMES]
        free = [n for n in stems if n not in columns and f"{n}_flag" not in columns]
        if free:
            break
        turn += 1
    name = shuffled(free, seed, "indicator")[0] + "_flag"
    return name, int(u_text(seed, "position", name) * max(1, len(columns)))


def insert_column(df: DataFrame, name: str, value: Column, position: int) -> DataFrame:
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*names[:position], value.alias(name), *names[position:])


def drop_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.drop(*[c for c in ids if c in df.columns])


def context_rows(df: DataFrame, row_id: str, around: object, reach: int = 5) -> DataFrame:
    """The rows within ``reach`` of the given row id."""
    at = F.lit(str(around)).try_cast("bigint")
    return df.where(F.col(row_id).between(at - reach, at + reach))
