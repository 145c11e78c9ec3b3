"""Column profiles: semantic type, kind and distinct count, from every cell of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions import text as X
from tabprobe.functions.draws import digest

DOMINANT = 0.9
_PREFILTER_ROWS = 50_000
_PREFILTER_MARGIN = 4


def cell_rows(df: DataFrame, key: str, dataset: str = "", seed: int = 0) -> DataFrame:
    """Every non-blank cell as text: ``(dataset, column, position, row, digest, cell)``."""
    names = df.columns
    texts = df.select(
        F.col(f"`{key}`").cast("bigint").alias("@row"),
        digest(seed, "cell", key).alias("@digest"),
        *[F.trim(F.col(f"`{n}`").cast("string")).alias(f"@{i}") for i, n in enumerate(names)],
    )
    long = texts.unpivot(["@row", "@digest"], [f"`@{i}`" for i in range(len(names))], "at", "cell")
    position = F.substring("at", 2, 10).cast("int")
    listed = F.array(*[F.lit(n) for n in names])
    return long.where(F.col("cell") != "").select(
        F.lit(dataset).alias("dataset"), F.element_at(listed, position + 1).alias("column"),
        position.alias("position"), F.col("@row").alias("row"),
        F.col("@digest").alias("digest"), "cell",
    )


def cell_draw(row_digest: Column, position: Column) -> Column:
    """Eight hex digits of the row's digest, a different window of it for each column."""
    return F.substr(row_digest, F.lit(1) + position % 24, F.lit(8))


def held_cells(df: DataFrame) -> list[int]:
    """Non-blank cells per column, in one pass."""
    shown = [F.trim(F.col(f"`{n}`").cast("string")) != "" for n in df.columns]
    return df.agg(F.array(*[F.count_if(c) for c in shown])).first()[0]


def _limited(cells: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first ``size`` cells of each column; the limit works in every task before the shuffle."""
    window = Window.partitionBy("dataset", "position").orderBy(*order)
    return cells.withColumn("place", F.row_number().over(window)).where(F.col("place") <= size)


def _sample_candidates(
    df: DataFrame, key: str, dataset: str, seed: int, size: int
) -> DataFrame:
    """Cells that can be in the sample.

    On large tables a threshold on the draw drops nearly all cells; counts per column prove that
    enough of them pass, and a column where they do not is left unfiltered.
    """
    cells = cell_rows(df, key, dataset, seed).withColumn(
        "draw", cell_draw(F.col("digest"), F.col("position"))
    )
    held = held_cells(df)
    if max(held, default=0) > _PREFILTER_ROWS:
        limits = [
            "%08x" % min(2**32 - 1, int(2**32 * size * _PREFILTER_MARGIN / max(1, n)))
            for n in held
        ]
        passing = df.agg(*[
            F.count_if(
                (F.trim(F.col(f"`{n}`").cast("string")) != "")
                & (cell_draw(digest(seed, "cell", key), F.lit(i)) < limits[i])
            ).alias(f"c{i}")
            for i, n in enumerate(df.columns)
        ]).first()
        limits = [
            limit if passing[i] >= min(size, held[i]) else "g"
            for i, limit in enumerate(limits)
        ]
        listed = F.array(*[F.lit(limit) for limit in limits])
        cells = cells.where(F.col("draw") < F.element_at(listed, F.col("position") + 1))
    return cells


def column_sample(
    tables: dict[str, DataFrame], key: str, size: int, seed: int = 0
) -> DataFrame:
    """Up to ``size`` random non-blank cells of each column of each table."""
    parts = [_sample_candidates(df, key, name, seed, size) for name, df in tables.items()]
    return _limited(reduce(DataFrame.unionByName, parts), ["draw", "row"], size)


def counted_cells(df: DataFrame, dataset: str) -> DataFrame:
    """Different non-blank cells of each column and how often each is there.

    Equal cells are summed up in every task before the shuffle.
    """
    names = df.columns
    texts = df.select(*[F.trim(F.col(f"`{n}`").cast("string")).alias(f"@{i}")
                        for i, n in enumerate(names)])
    long = texts.unpivot([], [f"`@{i}`" for i in range(len(names))], "at", "cell")
    return long.where(F.col("cell") != "").select(
        F.lit(dataset).alias("dataset"), F.substring("at", 2, 10).cast("int").alias("position"),
        "cell")


def vote(tables: dict[str, DataFrame]) -> DataFrame:
    """Semantic type and the facts behind the kind, per column, from all its cells.

    Cells are reduced to different cells, each of which is looked at once, and those to columns;
    the different numbers of a column are counted beside them, from the same shuffle. Every sum
    is of fixed size, so no task sorts cells, and a column of any size meets in one task only as
    a few partial sums.
    """
    cells = reduce(DataFrame.unionByName, [counted_cells(df, n) for n, df in tables.items()])
    cells = cells.groupBy("dataset", "position", "cell").agg(F.count("*").alias("n"))
    cell, normal = F.col("cell"), F.col("normal")
    known = ~X.is_missing(cell)
    number = cell.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    # The spellings of true and false are a short fixed list: one bit each.
    spellings = F.array(*[F.lit(t) for t in (*X.TRUE_TOKENS, *X.FALSE_TOKENS)])
    spelling = F.call_function(
        "shiftleft", F.lit(1), (F.array_position(spellings, X.clean(cell)) - 1).cast("int"))
    tagged = cells.withColumn("normal", X.normalise_numeric(cell)).select(
        "dataset", "position", "n", known.alias("known"),
        (known & X.is_bool_token(cell)).alias("bool_form"),
        F.when(known & X.is_bool_token(cell), spelling).alias("form"),
        F.when(known, F.when(X.parse_datetime(cell).isNotNull(), "datetime")
               .when(X.is_int_text(normal), "int").when(X.is_float_text(normal), "float")
               .otherwise("string")).alias("as"),
        F.when(known & X.is_int_text(normal), normal.try_cast("decimal(38,0)")).alias("whole"),
        number.alias("number"), finite.alias("finite"),
    )

    def times(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("n")).otherwise(0))

    # Cells are counted here, so that both sides read one and the same shuffle.
    numbers = cells.groupBy("dataset", "position", number.alias("number")).agg(
        F.sum("n").alias("n")).groupBy("dataset", "position").agg(
        F.count("number").alias("numbers"), F.sum("n").alias("cells"))
    counts = tagged.groupBy("dataset", "position").agg(
        times(F.col("known")).alias("total"), times(F.col("bool_form")).alias("bool_forms"),
        *[times(F.col("as") == t).alias(t) for t in ("int", "float", "datetime", "string")],
        F.count("*").alias("unique_count"), times(F.col("whole").isNotNull()).alias("wholes"),
        F.coalesce(F.bit_count(F.bit_or("form")), F.lit(0)).alias("forms"),
        F.min("whole").alias("low"), F.max("whole").alias("high"),
        F.bool_and("finite").alias("all_finite"),
        F.coalesce(F.bool_or(F.col("number") != F.floor("number")), F.lit(False)).alias("fractional"),
    ).join(numbers, ["dataset", "position"])
    total = F.col("total")

    def share(*names: str) -> Column:
        return F.try_divide(sum((F.col(n) for n in names), F.lit(0)), total)

    numeric_type = F.when(F.col("float") > 0, "float").otherwise("int")
    others = F.col("datetime") + F.col("string")
    # A column is boolean only as a whole: every known cell, in at most six spellings.
    all_bool = (F.col("bool_forms") == total) & (F.col("forms") <= 6)
    dtype = (
        F.when(total == 0, "empty")
        .when(all_bool, "bool")
        .when((F.col("datetime") > 0) & (share("datetime") >= DOMINANT), "datetime")
        .when((share("int") >= DOMINANT) | (share("float") >= DOMINANT), numeric_type)
        .when(share("string") >= DOMINANT, "string")
        .when((share("int", "float") >= DOMINANT) & (others == 0), numeric_type)
        .otherwise("mixed")
    )
    # 1, 2, 3, ... in any order: every cell a different whole number from 1 to their number.
    rows = F.max("cells").over(Window.partitionBy("dataset"))  # one row per column of a table
    sequential = (
        (F.col("wholes") == F.col("cells")) & (F.col("low") == 1)
        & (F.col("high") == F.col("cells")) & (F.col("numbers") == F.col("cells"))
        & (F.col("cells") >= F.least(F.lit(20), rows))
    )
    return counts.withColumns({
        "dtype": dtype, "span": F.col("high") - F.col("low"),
        "sequential": F.coalesce(sequential, F.lit(False)),
    })


def sequential_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns that hold 1, 2, 3, ..., each once: ``(dataset, column, sequential)``."""
    return named_columns(tables).join(vote(tables), ["dataset", "position"]).select(
        "dataset", "column", "sequential"
    )


def kind_of() -> Column:
    """Kind rule: id, binary, small whole range, regression, else categorical."""
    unique = F.col("unique_count")
    regression = F.col("all_finite") & (F.col("cells") >= 2) & (
        (F.col("numbers") / F.col("cells") > 0.5)
        | (F.col("fractional") & (F.col("numbers") > 10))
        | (F.col("numbers") > 20)
    )
    small_range = (
        F.col("dtype").isin("int", "bool") & (F.col("wholes") > 0)
        & (F.col("span") <= 31) & (unique <= 64)
    )
    return (
        F.when(F.col("sequential"), "id_no")
        .when(unique == 2, "binary")
        .when(small_range, "categorical")
        .when((unique > 2) & regression, "regression")
        .otherwise("categorical")
    )


def named_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column; the last column is the target."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        [(name, i, c, i == len(df.columns) - 1) for name, df in tables.items()
         for i, c in enumerate(df.columns)],
        "dataset string, position int, column string, is_target boolean",
    )


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column:
    ``(dataset, column, position, kind, dtype, unique_count, is_target)``.

    The last column is the target. Columns without any cell are ``empty`` and categorical. All
    cells of all tables are read once, in one plan without any job of its own.
    """
    found = named_columns(tables).join(vote(tables), ["dataset", "position"], "left")
    empty = F.col("dtype").isNull()
    return found.select(
        "dataset", "column", "position",
        F.when(empty, "categorical").otherwise(kind_of()).alias("kind"),
        F.coalesce("dtype", F.lit("empty")).alias("dtype"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"), "is_target",
    )


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """The profile of one table."""
    return profile_all({dataset: df})


def nested_profile(profiles: DataFrame) -> DataFrame:
    """One row per dataset: target, columns by name, and column names by kind."""
    listed = F.array_sort(F.collect_list(F.struct(
        "column", F.struct("kind", "dtype", "unique_count").alias("facts")
    )))
    by_kind = {
        kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("column"))))
        for kind in ("binary", "regression", "categorical", "id_no")
    }
    return profiles.groupBy("dataset").agg(
        F.max(F.when(F.col("is_target"), F.col("column"))).alias("target"),
        F.map_from_entries(listed).alias("columns"),
        F.create_map(*[x for k, v in by_kind.items() for x in (F.lit(k), v)]).alias("by_kind"),
    )


def flat_profile(nested: DataFrame) -> DataFrame:
    """The long form of a stored nested profile."""
    rows = nested.select("dataset", "target", F.explode("columns").alias("column", "facts"))
    return rows.select(
        "dataset", "column", "facts.kind", "facts.dtype",
        F.col("facts.unique_count").cast("bigint").alias("unique_count"),
        (F.col("column") == F.col("target")).alias("is_target"),
    )
