"""Number rules: coercion, rounding, decimal places, period split, typed literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NUMBER_PATTERN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def to_double(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number, NaN, dates and nested values become null."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return F.col(name).cast("double")
    if isinstance(dtype, T.StringType):
        text = F.trim(F.col(name))
        # The pattern spares the failing casts, which are slow, on columns of words.
        return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.lit(None).cast("double")


def coercible(df: DataFrame, name: str) -> bool:
    """Whether :func:`to_double` can give anything but null for this column type."""
    dtype = dtype_of(df, name)
    return is_number(dtype) or isinstance(dtype, (T.BooleanType, T.StringType))


def to_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace the named columns by their double form."""
    return df.withColumns({name: to_double(df, name) for name in names})


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def typed_literal(df: DataFrame, name: str, value: object) -> Column:
    """The value as the column's own type; null when it does not parse."""
    return F.lit(str(value)).try_cast(dtype_of(df, name))


def equals_value(df: DataFrame, name: str, value: object) -> Column:
    """Compare with a text value in the column's type, or as text where it does not parse."""
    typed = typed_literal(df, name, value)
    return F.when(typed.isNotNull(), F.col(name) == typed).otherwise(
        F.col(name).cast("string") == F.lit(str(value))
    )


def period_split(df: DataFrame, name: str, split: object) -> Column:
    """'A' before the split value, 'B' from it on, null for null."""
    typed = typed_literal(df, name, split)
    text = F.lit(str(split))
    as_text = F.col(name).cast("string")
    return F.when(
        typed.isNotNull(),
        F.when(F.col(name) < typed, F.lit("A")).when(F.col(name) >= typed, F.lit("B")),
    ).otherwise(F.when(as_text < text, F.lit("A")).when(as_text >= text, F.lit("B")))


def decimal_places(value: Column) -> Column:
    """Digits after the point of the shortest decimal text; a whole number counts as one."""
    text = value.cast("double").cast("string")
    plain = F.length(F.substring_index(text, ".", -1))
    spread = F.rtrim(text.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    long = F.coalesce(F.length(F.substring_index(spread, ".", -1)), F.lit(1))
    # Very large and very small numbers are written with an exponent.
    return F.when(
        value.isNotNull(), F.when(~text.contains("E"), plain).otherwise(F.greatest(F.lit(1), long))
    )


def typical_decimals(value: Column) -> Column:
    """Aggregate: median number of decimal places, cut to an integer, 2 when there is no value.

    The exact percentile is safe here at any size: its state holds one counter per distinct
    number of digits, of which there are at most nineteen.
    """
    return F.coalesce(F.percentile(decimal_places(value), F.lit(0.5)).cast("int"), F.lit(2))


def is_whole(value: Column) -> Column:
    """Close to a whole number (relative 1e-5, absolute 1e-8)."""
    return F.abs(value - F.rint(value)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(value))


def round_even(value: Column, places: int) -> Column:
    return F.bround(value, places)
