"""Tables of any columns in one physical schema, so that one scan reads many of them.

A column lies under a place of its kind: ``i0, i1, ...`` whole numbers and truth values, ``f0, ...``
other numbers, ``d0, ...`` dates, ``s0, ...`` timestamps and ``t0, ...`` everything else as text.
Names and types are kept apart, as a list of :data:`COLUMN` records. Parquet reads a place that a
file does not have as null, so files of all tables fit the schema of the widest one, and only the
places that are asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.numbers import NUMBER_PATTERN

COLUMN = "struct<name: string, type: string, kind: string, at: int>"
KINDS = {"i": "bigint", "f": "double", "d": "date", "s": "timestamp", "t": "string"}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, _WHOLE):
        return "i"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "f"
    return {T.DateType: "d", T.TimestampType: "s"}.get(type(dtype), "t")


def columns_of(schema: T.StructType) -> list[dict]:
    """The record of each column, in table order."""
    held = dict.fromkeys(KINDS, 0)
    found = []
    for field in schema.fields:
        kind = kind_of(field.dataType)
        found.append({"name": field.name, "type": field.dataType.simpleString(),
                      "kind": kind, "at": held[kind]})
        held[kind] += 1
    return found


def pressed(df: DataFrame) -> DataFrame:
    """The rows of a table under its places."""
    def value(field: T.StructField, kind: str) -> Column:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _NESTED):
            return F.to_json(cell, {"ignoreNullFields": "false"})
        if isinstance(field.dataType, T.BinaryType):
            return F.base64(cell)
        return cell.cast(KINDS[kind])

    return df.select(*[
        value(field, c["kind"]).alias(f"{c['kind']}{c['at']}")
        for field, c in zip(df.schema.fields, columns_of(df.schema))
    ])


def restored(rows: DataFrame, columns: list[dict]) -> DataFrame:
    """The table whose columns lie under the places of `rows`, with its own names and types."""
    def value(c: dict) -> Column:
        cell, kind = F.col(f"{c['kind']}{c['at']}"), c["type"].split("<")[0]
        if kind in ("array", "map", "struct"):
            return F.from_json(cell, c["type"])
        return F.unbase64(cell) if kind == "binary" else cell.cast(c["type"])

    return rows.select(*[value(c).alias(c["name"]) for c in columns])


def widths(columns: DataFrame) -> dict[str, int]:
    """How many places of each kind the widest of some tables has; `columns` has them as a list."""
    def held(kind: str) -> Column:
        return F.max(F.size(F.filter("columns", lambda c: c["kind"] == kind))).alias(kind)

    most = columns.agg(*[held(k) for k in KINDS]).first()
    return {k: most[k] or 0 for k in KINDS}


def physical_schema(of_kind: dict[str, int], partitions: str = "") -> str:
    """DDL of all places, then the partition columns."""
    places = [f"{k}{n} {KINDS[k]}" for k in KINDS for n in range(of_kind[k])]
    return ", ".join([*places, *([partitions] if partitions else [])])


def read_places(
    spark: SparkSession, path: str, of_kind: dict[str, int], partitions: str
) -> DataFrame:
    """Rows of all tables below `path`: the partition columns and an array of places per kind."""
    rows = spark.read.schema(physical_schema(of_kind, partitions)).parquet(path)
    kept = [p.split()[0] for p in partitions.split(", ")]
    return rows.select(*kept, *[
        F.array(*[F.col(f"{k}{n}") for n in range(of_kind[k])]).cast(f"array<{KINDS[k]}>")
        .alias(f"_{k}") for k in KINDS
    ])


def each_cell(rows: DataFrame, features: str, *kept: str | Column) -> DataFrame:
    """A row for each row and column record in the array `features`: `kept`, the record as `cell`.

    The arrays of places stay beside it. Records are unfolded before cells are read by them, which
    keeps the reading in generated code; inside a lambda it is interpreted, cell by cell.
    """
    places = [f"_{k}" for k in KINDS]
    return rows.select(*kept, *places, F.explode(features).alias("cell"))


def number_of(c: Column) -> Column:
    """A cell of :func:`read_places` as double, by the rules for the column's type."""
    real = F.get("_f", c["at"])
    text = F.trim(F.get("_t", c["at"]))
    readable = (c["type"] == "string") | c["type"].startswith("decimal")
    return (
        F.when(c["kind"] == "i", F.get("_i", c["at"]).cast("double"))
        .when(c["kind"] == "f", F.when(~F.isnan(real), real))
        .when((c["kind"] == "t") & readable & text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    )


def may_be_number(c: Column) -> Column:
    """Whether :func:`number_of` can give anything but null for a column of this type."""
    return c["kind"].isin("i", "f") | (c["type"] == "string") | c["type"].startswith("decimal")


def is_number(c: Column) -> Column:
    """Whether the column's type is one of numbers."""
    return ((c["kind"] == "i") & (c["type"] != "boolean")) | (c["kind"] == "f") | (
        c["type"].startswith("decimal"))


def text_of(c: Column) -> Column:
    """A cell as text, as a cast of the column to string gives it."""
    whole, real = F.get("_i", c["at"]), F.get("_f", c["at"])
    return (
        F.when(c["type"] == "boolean", (whole == 1).cast("string"))
        .when(c["kind"] == "i", whole.cast("string"))
        .when(c["type"] == "float", real.cast("float").cast("string"))
        .when(c["kind"] == "f", real.cast("string"))
        .when(c["kind"] == "d", F.get("_d", c["at"]).cast("string"))
        .when(c["kind"] == "s", F.get("_s", c["at"]).cast("string"))
        .otherwise(F.get("_t", c["at"]))
    )


def _by_type(c: Column, value: Column, test) -> Column:
    """`test(cell, value)` in the column's type, or as text where the value does not parse."""
    wide = "decimal(38,18)"
    typed = (
        F.when(c["type"] == "boolean", test(F.get("_i", c["at"]) == 1, value.try_cast("boolean")))
        .when(c["kind"] == "i", test(F.get("_i", c["at"]), value.try_cast("bigint")))
        .when(c["kind"] == "f", test(F.get("_f", c["at"]), value.try_cast("double")))
        .when(c["kind"] == "d", test(F.get("_d", c["at"]), value.try_cast("date")))
        .when(c["kind"] == "s", test(F.get("_s", c["at"]), value.try_cast("timestamp")))
        .when(c["type"].startswith("decimal"),
              test(F.get("_t", c["at"]).try_cast(wide), value.try_cast(wide)))
    )
    parses = (
        F.when(c["type"] == "boolean", value.try_cast("boolean").isNotNull())
        .when(c["kind"] == "i", value.try_cast("bigint").isNotNull())
        .when(c["kind"] == "f", value.try_cast("double").isNotNull())
        .when(c["kind"] == "d", value.try_cast("date").isNotNull())
        .when(c["kind"] == "s", value.try_cast("timestamp").isNotNull())
        .otherwise(c["type"].startswith("decimal") & value.try_cast(wide).isNotNull())
    )
    return F.when(parses, typed).otherwise(test(text_of(c), value))


def equals(c: Column, value: Column) -> Column:
    return _by_type(c, value, lambda cell, other: cell == other)


def period(c: Column, split: Column) -> Column:
    """'A' before the split value, 'B' from it on, null for null."""
    return _by_type(c, split, lambda cell, other: F.when(cell < other, F.lit("A")).when(
        cell >= other, F.lit("B")))
