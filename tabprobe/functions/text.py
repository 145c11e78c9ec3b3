"""Text rules for raw cells: missing tokens, booleans, number clean-up, dates, questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing", and tokens that mean true or false.
MISSING_TOKENS = (
    "na", "n/a", "nan", "null", "none", "nil", "missing", "?", "-", "--", "undefined",
)
TRUE_TOKENS = ("true", "t", "yes", "y", "on", "1")
FALSE_TOKENS = ("false", "f", "no", "n", "off", "0")

# The accepted date and time layouts, first hit wins.
DATE_LAYOUTS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy",
    "yyyy-M-d H:m:s", "yyyy-M-d H:m",
    "yyyy/M/d H:m:s", "yyyy/M/d H:m",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m",
    "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
)
# Only text of this shape is handed to the date parsers.
_DATE_SHAPE = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?Z?)?$"
_LONGEST_DATE = 32

INT_PATTERN = r"^[+-]?\d+$"
FLOAT_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def clean(value: Column) -> Column:
    return F.lower(F.trim(value))


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def is_missing(value: Column) -> Column:
    """Whether the cell is one of the missing tokens (a blank cell is not)."""
    return clean(value).isin(*MISSING_TOKENS)


def is_bool_token(value: Column) -> Column:
    return clean(value).isin(*TRUE_TOKENS, *FALSE_TOKENS)


def normalise_numeric(value: Column) -> Column:
    """Strip brackets (negative), currency signs, thousands commas and a trailing percent sign.

    Text without any of these signs is only trimmed.
    """
    text = F.regexp_replace(F.trim(value), r"^(?s)\(\s*(.*?)\s*\)$", "-$1")
    text = F.regexp_replace(text, r"[$€£¥]", "")
    text = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(\D|$))", "")
    text = F.regexp_replace(text, r"%$", "")
    return F.when(value.rlike(r"[($€£¥,%]"), F.trim(text)).otherwise(F.trim(value))


def is_int_text(normalised: Column) -> Column:
    return normalised.rlike(INT_PATTERN)


def is_float_text(normalised: Column) -> Column:
    return normalised.rlike(FLOAT_PATTERN)


def parse_int(value: Column) -> Column:
    """Whole number in the cell after clean-up, else null."""
    normalised = normalise_numeric(value)
    return F.when(
        ~is_missing(value) & is_int_text(normalised), normalised.try_cast("decimal(38,0)")
    )


def parse_datetime(value: Column) -> Column:
    """Timestamp by the first layout that fits, else null."""
    tried = F.coalesce(*[F.try_to_timestamp(value, F.lit(layout)) for layout in DATE_LAYOUTS])
    fits = (F.length(value) <= _LONGEST_DATE) & value.rlike(_DATE_SHAPE)
    return F.when(fits, tried)


def has_time(value: Column) -> Column:
    return value.rlike("[:TZ]")


def render_question(question: Column, slots: Column) -> Column:
    """Replace each ``{SLOT}`` by its value; a slot without a value stays as written."""
    return F.aggregate(
        F.map_entries(slots),
        question,
        lambda text, slot: F.replace(
            text, F.concat(F.lit("{"), slot["key"], F.lit("}")), slot["value"]
        ),
    )


def resolve_params(mapping: Column, slots: Column) -> Column:
    """A parameter written ``{SLOT}`` takes the slot's value; anything else is literal."""
    def resolve(_: Column, value: Column) -> Column:
        name = F.regexp_extract(value, r"^\{(\w+)\}$", 1)
        return F.when(name == "", value).otherwise(F.coalesce(F.try_element_at(slots, name), value))

    return F.transform_values(mapping, resolve)


def pair_text(first: Column, second: Column) -> Column:
    """Two names in alphabetical order, comma separated."""
    return F.concat_ws(", ", F.least(first, second), F.greatest(first, second))


def first_containing(text: Column, labels: list[tuple[str, str]], default: Column) -> Column:
    """Label of the first substring found in the text, in the given order."""
    return reduce(
        lambda rest, pair: F.when(text.contains(pair[0]), F.lit(pair[1])).otherwise(rest),
        reversed(labels),
        default,
    )
