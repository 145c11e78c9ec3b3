"""Exact order statistics, quantiles and mid-ranks that never gather a group in one task.

A group here is one feature (or one model x run) and may hold any share of the rows. Its size
is counted first. Up to ``SMALL_GROUP`` values per group the built-in ``percentile`` or a plain
window is used. Beyond that each group's value range is cut into buckets:

* quantiles of numbers come from brackets around the wanted positions: a mergeable sketch with a
  bounded rank error gives them, one more pass counts what lies between and keeps what lies inside;
* for ranks, the range of the numbers is cut into parts, and parts that are full are cut again
  between their own ends; texts are cut at values that a hash chooses;
* bucket counts are a small table whose running sum tells how many values lie below a bucket;
  ranks sort inside (group, bucket).

Equal values are merged into one counted row first, so a value held by a third of the rows
costs no more than any other.

Group keys travel as one struct, which is never null, so a null key is a group like any other in
every join; both ways give the same rows and the same bits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.sources.shared import cut

SMALL_GROUP = 1_000_000
ROWS_PER_BUCKET = 200_000
BUCKET_BITS = 16
BROADCAST_GROUPS = 10_000
_HASH_RANGE = 2**40
GROUP = "_group"


class GroupSizes(NamedTuple):
    largest: int
    groups: int

    def small(self, limit: int) -> bool:
        return self.largest <= limit

    def share(self, table: DataFrame) -> DataFrame:
        """Broadcast a table with a few rows per group only where the groups were counted few."""
        return F.broadcast(table) if self.groups <= BROADCAST_GROUPS else table


def group_sizes(rows: DataFrame, by: list[str], value: str) -> GroupSizes:
    """Values in the largest group, and the number of groups (two numbers to the driver)."""
    counts = rows.groupBy(*by).agg(F.count(value).alias("n"))
    found = counts.agg(F.max("n").alias("largest"), F.count("*").alias("groups")).first()
    return GroupSizes(found["largest"] or 0, found["groups"])


def feature_sizes(df: DataFrame, names: list[str]) -> GroupSizes:
    """Upper bound for the groups of an unpivoted table: no column has more values than rows.

    A row count needs no column, so on Parquet it is read from the file footers.
    """
    return GroupSizes(df.count(), len(names))


def bucket_of(value: Column, cuts: Column, bits: int = BUCKET_BITS) -> Column:
    """Number of cut points below the value, 2**bits - 1 at most, by binary search.

    Should the hash have picked more cuts than that, the values above them share a bucket.
    """
    steps = F.array(*[F.lit(2**bit) for bit in reversed(range(bits))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            F.coalesce(F.get(cuts, low + step - 1) < value, F.lit(False)), low + step
        ).otherwise(low),
    )


def _between_cuts(
    rows: DataFrame, by: list[str], value: str, sizes: GroupSizes, rows_per_bucket: int
) -> tuple[DataFrame, DataFrame]:
    """Buckets between cut points: distinct values whose hash falls under buckets / rows.

    For texts, which have no image of fixed size. The cuts follow the data, need one narrow pass,
    and are the same on every evaluation.
    """
    # Twice the buckets asked for leave room for the chance in how many cuts the hash picks.
    bits = min(BUCKET_BITS, (2 * sizes.largest // rows_per_bucket + 15).bit_length())
    most = 2**bits - 1
    wanted = rows.groupBy(*by).agg(F.count("*").alias("_rows")).withColumn(
        "_share",
        F.least(F.lit(most / 2) / F.col("_rows"), F.lit(1.0 / rows_per_bucket))
        * F.lit(float(_HASH_RANGE)),
    )
    cuts = (
        rows.join(sizes.share(wanted), by)
        .where(F.pmod(F.xxhash64(value), F.lit(_HASH_RANGE)) < F.col("_share"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set(value)).alias("_cuts"))
    )
    bucketed = rows.join(sizes.share(cuts), by, "left").withColumn(
        "_bucket", F.coalesce(bucket_of(F.col(value), F.col("_cuts"), bits), F.lit(0))
    ).drop("_cuts")
    return bucketed, bucketed.groupBy(*by, "_bucket").agg(F.count("*").alias("_held"))


_LARGEST = 1.7976931348623157e308


def _shares(x: Column, low: Column, high: Column, parts: Column) -> Column:
    """Which of `parts` equal parts of the way from low to high a value lies in, from 0.

    Every step rounds in the same direction for larger values, so no value gets a smaller part
    than a smaller one.
    """
    def tame(c: Column) -> Column:
        return F.greatest(F.least(c.cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST)) / 4

    way = F.try_divide(tame(x) - tame(low), tame(high) - tame(low))
    return F.least(F.floor(F.coalesce(way, F.lit(0.0)) * parts), parts - 1).cast("bigint")


def _by_range(
    rows: DataFrame, by: list[str], value: str, sizes: GroupSizes, rows_per_bucket: int
) -> tuple[DataFrame, DataFrame]:
    """Buckets that are parts of the range of the values, and parts of those where they are full.

    A bucket that holds too many values, not all of them equal, is cut again between its own
    smallest and largest value, so that values that crowd together far from others are told apart.
    A bucket goes by the path of its parts, which has the order of the values.
    """
    rows = rows.withColumn("_bucket", F.array().cast("array<bigint>"))
    counts = None
    while True:
        keys = [*by, "_bucket"]
        found = cut((rows if counts is None else rows.where("_full")).groupBy(*keys).agg(
            F.count("*").alias("_held"), F.min(value).alias("_low"), F.max(value).alias("_high")))
        full = (F.col("_held") > rows_per_bucket) & (F.col("_low") < F.col("_high"))
        done = found.where(~full).select(*keys, "_held")
        counts = done if counts is None else counts.unionByName(done)
        parts = F.least(F.lit(4 / rows_per_bucket) * F.col("_held") + 2, F.lit(65_536.0))
        more = cut(found.where(full).select(
            *keys, "_low", "_high", parts.cast("bigint").alias("_parts"), F.lit(True).alias("_full")))
        many = more.count()
        rows = rows.drop("_full")
        if not many:
            return rows, counts
        inner = F.array_append("_bucket", _shares(
            F.col(value), F.col("_low"), F.col("_high"), F.col("_parts")))
        rows = rows.join(F.broadcast(more) if many <= BROADCAST_GROUPS else more, keys, "left"
                         ).withColumn("_bucket", F.when(F.col("_full"), inner).otherwise(
                             F.col("_bucket"))).drop("_low", "_high", "_parts")


def _selected(
    rows: DataFrame, by: list[str], value: str, wanted: DataFrame, sizes: GroupSizes,
    rows_per_bucket: int,
) -> DataFrame | None:
    """The values at positions ``k`` of ``wanted``, or None if a bracket missed one.

    A mergeable quantile sketch of each group, whose rank error is bounded, gives a bracket of
    values around each wanted position. One more pass counts the values between the brackets and
    keeps those inside, which are few; each position is found by counting.
    """
    steps = int(min(max(sizes.largest / rows_per_bucket * 4, 16), 4_096))
    grid = F.percentile_approx(
        value, F.array(*[F.lit(i / steps) for i in range(steps + 1)]), F.lit(steps * 8))
    sketch = cut(rows.groupBy(*by).agg(grid.alias("_grid"), F.count("*").alias("_rows")))
    at = F.col("k") * F.lit(float(steps)) / F.greatest(F.col("_rows") - 1, F.lit(1))
    near = wanted.join(sketch, by).select(
        *by, F.struct(
            F.get("_grid", F.greatest(F.floor(at) - 1, F.lit(0)).cast("int")).alias("low"),
            F.get("_grid", F.least(F.ceil(at) + 1, F.lit(steps)).cast("int")).alias("high"),
        ).alias("pair"))
    # A value's place among the bounds: twice the bounds below it, one more where it is a bound.
    bounds = F.array_sort(F.array_distinct(F.concat("_pairs.low", "_pairs.high")))
    brackets = cut(near.groupBy(*by).agg(F.collect_set("pair").alias("_pairs")).select(
        *by, bounds.alias("_bounds"), "_pairs").select(
        *by, "_bounds", F.flatten(F.transform("_bounds", lambda b: F.array(
            F.exists("_pairs", lambda p: (p["low"] < b) & (b <= p["high"])),
            F.exists("_pairs", lambda p: (p["low"] <= b) & (b <= p["high"]))))).alias("_inside")))
    most = brackets.agg(F.max(F.size("_bounds"))).first()[0] or 0
    x = F.col(value)
    place = sum((F.when(F.get("_bounds", F.lit(i)) < x, 2)
                 .when(F.get("_bounds", F.lit(i)) == x, 1).otherwise(0) for i in range(most)), F.lit(0))
    placed = rows.join(sizes.share(brackets), by).withColumn("_bucket", place)
    kept = placed.withColumn("_kept", F.when(F.get("_inside", F.col("_bucket")), x))
    counted = kept.groupBy(*by, "_bucket", "_kept").agg(F.count("*").alias("n"))
    counted = cut(counted)
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*by, "_bucket").agg(F.sum("n").alias("_held")).withColumn(
        "_ahead", F.coalesce(F.sum("_held").over(ahead), F.lit(0))).drop("_held")
    within = Window.partitionBy(*by, "_bucket").orderBy("_kept").rowsBetween(
        Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(within), F.lit(0))
    inside = counted.where(F.col("_kept").isNotNull()).withColumn("below", below).join(
        totals, [*by, "_bucket"]).withColumn("below", F.col("below") + F.col("_ahead"))
    hit = (F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("n"))
    found = cut(inside.join(sizes.share(wanted), by).where(hit).select(
        *by, "k", F.col("_kept").alias(value)))
    asked = wanted.join(sketch.select(*by, "_rows"), by).where(
        (F.col("k") >= 0) & (F.col("k") < F.col("_rows")))
    return found if found.count() == asked.count() else None


def _bucketed(
    rows: DataFrame, by: list[str], value: str, sizes: GroupSizes, rows_per_bucket: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket, and per bucket how many values it holds and how many lie below it."""
    rows = rows.where(F.col(value).isNotNull())
    number = isinstance(rows.schema[value].dataType, T.NumericType)
    split = _by_range if number else _between_cuts
    bucketed, counts = split(rows, by, value, sizes, rows_per_bucket)
    ahead = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return bucketed, counts.withColumn("_ahead", F.coalesce(F.sum("_held").over(ahead), F.lit(0)))


def _with_below(counted: DataFrame, within: list[str]) -> DataFrame:
    """Add ``below``: how many values of the partition are smaller."""
    window = Window.partitionBy(*within).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return counted.withColumn("below", F.coalesce(F.sum("n").over(window), F.lit(0)))


def order_statistics(
    rows: DataFrame,
    by: list[str],
    value: str,
    wanted: DataFrame,
    sizes: GroupSizes | None = None,
    small_group: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Values at 0-based positions ``k`` of ``wanted(by..., k)`` in each group's sorted order."""
    found = _order_statistics(
        rows.select(group_key(by), F.col(value).alias("_value")), "_value",
        wanted.select(group_key(by), "k"), sizes, small_group, rows_per_bucket,
    )
    return found.select(*group_columns(by), "k", F.col("_value").alias(value))


def group_key(by: list[str]) -> Column:
    """The columns ``by`` as one struct; without any, all rows are one group."""
    return F.struct(*[F.col(f"`{c}`") for c in by] or [F.lit(0).alias("all")]).alias(GROUP)


def group_columns(by: list[str]) -> list[Column]:
    return [F.col(f"{GROUP}.`{c}`").alias(c) for c in by]


def _order_statistics(
    rows: DataFrame, value: str, wanted: DataFrame, sizes: GroupSizes | None,
    small_group: int | None, rows_per_bucket: int,
) -> DataFrame:
    by = [GROUP]
    small_group = SMALL_GROUP if small_group is None else small_group
    rows = rows.where(F.col("_value").isNotNull())
    sizes = sizes or group_sizes(rows, by, "_value")
    wanted = wanted.select(*by, "k").distinct()
    hit = (F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("n"))
    if sizes.small(small_group):
        counted = rows.groupBy(*by, "_value").agg(F.count("*").alias("n"))
        placed = _with_below(counted, by).join(sizes.share(wanted), by)
        return placed.where(hit).select(*by, "k", value)
    if isinstance(rows.schema["_value"].dataType, T.NumericType):
        found = _selected(rows, by, "_value", wanted, sizes, rows_per_bucket)
        if found is not None:
            return found
    bucketed, totals = _bucketed(rows, by, "_value", sizes, rows_per_bucket)
    targets = totals.join(sizes.share(wanted), by).where(
        (F.col("k") >= F.col("_ahead")) & (F.col("k") < F.col("_ahead") + F.col("_held"))
    ).select(*by, "_bucket", "_ahead", "k")
    zoomed = bucketed.join(
        sizes.share(targets.select(*by, "_bucket").distinct()), [*by, "_bucket"]
    )
    counted = zoomed.groupBy(*by, "_bucket", "_value").agg(F.count("*").alias("n"))
    placed = _with_below(counted, [*by, "_bucket"]).join(
        sizes.share(targets), [*by, "_bucket"]
    ).withColumn("below", F.col("below") + F.col("_ahead"))
    return placed.where(hit).select(*by, "k", value)


def quantiles(
    rows: DataFrame,
    by: list[str],
    value: str,
    probs: list[float],
    sizes: GroupSizes | None = None,
    small_group: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``(by..., quantiles array<double>)``."""
    found = _quantiles(
        rows.select(group_key(by), F.col(value).cast("double").alias("_value")), probs, sizes,
        small_group, rows_per_bucket,
    )
    return found.select(*group_columns(by), "quantiles")


def _quantiles(
    rows: DataFrame, probs: list[float], sizes: GroupSizes | None, small_group: int | None,
    rows_per_bucket: int,
) -> DataFrame:
    by = [GROUP]
    small_group = SMALL_GROUP if small_group is None else small_group
    groups = rows.groupBy(*by).agg(F.count("_value").alias("_rows"))
    if sizes is None:
        groups = cut(groups)
        found = groups.agg(F.max("_rows").alias("largest"), F.count("*").alias("groups")).first()
        sizes = GroupSizes(found["largest"] or 0, found["groups"])
    if sizes.small(small_group):
        return rows.groupBy(*by).agg(
            F.percentile("_value", F.array(*[F.lit(float(p)) for p in probs])).alias("quantiles")
        )
    # (n - 1) * p is the fractional position of each quantile; a group may have no values at all.
    spots = groups.where(F.col("_rows") > 0).select(
        *by,
        F.posexplode(F.array(*[F.lit(float(p)) * (F.col("_rows") - 1) for p in probs])).alias(
            "_at", "_spot"
        ),
    )
    wanted = spots.select(
        *by, F.explode(F.array(F.floor("_spot"), F.ceil("_spot"))).alias("k")
    )
    found = _order_statistics(rows, "_value", wanted, sizes, small_group, rows_per_bucket)
    low = found.select(*by, F.col("k").alias("_lo"), F.col("_value").alias("_lo_value"))
    high = found.select(*by, F.col("k").alias("_hi"), F.col("_value").alias("_hi_value"))
    joined = (
        spots.withColumns({"_lo": F.floor("_spot"), "_hi": F.ceil("_spot")})
        .join(sizes.share(low), [*by, "_lo"])
        .join(sizes.share(high), [*by, "_hi"])
    )
    # As the built-in percentile weighs the two values.
    step = F.when(F.col("_lo_value") == F.col("_hi_value"), F.col("_lo_value")).otherwise(
        (F.col("_hi") - F.col("_spot")) * F.col("_lo_value")
        + (F.col("_spot") - F.col("_lo")) * F.col("_hi_value")
    )
    filled = joined.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_at"), step.alias("value")))).alias("_all")
    ).select(*by, F.col("_all.value").alias("quantiles"))
    return groups.select(*by).join(sizes.share(filled), by, "left")


def medians(rows: DataFrame, by: list[str], value: str, **sizing) -> DataFrame:
    """Median per group: ``(by..., median)``."""
    return quantiles(rows, by, value, [0.5], **sizing).select(
        *by, F.col("quantiles")[0].alias("median")
    )


def value_ranks(
    rows: DataFrame,
    by: list[str],
    value: str,
    extra: list[Column] = (),
    sizes: GroupSizes | None = None,
    small_group: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct value: ``(by..., value, n, extra..., below, mid_rank)``.

    ``mid_rank`` is the 1-based average rank of the tied rows. ``extra`` are aggregates of the
    rows behind each value.
    """
    names, by = by, [GROUP]
    small_group = SMALL_GROUP if small_group is None else small_group
    rows = rows.where(F.col(value).isNotNull()).select(
        "*", group_key(names), F.col(value).alias("_value")
    )
    sizes = sizes or group_sizes(rows, by, "_value")
    if sizes.small(small_group):
        counted = rows.groupBy(*by, "_value").agg(F.count("*").alias("n"), *extra)
        placed = _with_below(counted, by)
    else:
        bucketed, totals = _bucketed(rows, by, "_value", sizes, rows_per_bucket)
        counted = bucketed.groupBy(*by, "_bucket", "_value").agg(F.count("*").alias("n"), *extra)
        placed = (
            _with_below(counted, [*by, "_bucket"])
            .join(sizes.share(totals.drop("_held")), [*by, "_bucket"])
            .withColumn("below", F.col("below") + F.col("_ahead"))
            .drop("_bucket", "_ahead")
        )
    placed = placed.withColumn("mid_rank", F.col("below") + (F.col("n") + 1) / F.lit(2.0))
    others = [c for c in placed.columns if c not in (GROUP, "_value")]
    return placed.select(*group_columns(names), F.col("_value").alias(value), *others)
