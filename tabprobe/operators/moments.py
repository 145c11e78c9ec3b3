"""One-pass statistics: moments, gaps, correlations, effect sizes, variance tests, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.numbers import (
    coercible, equals_value, is_number, period_split, to_double,
)
from tabprobe.operators.columns import distinct_reaches, unpivot_numbers
from tabprobe.operators.ranks import feature_sizes, medians, quantiles, value_ranks


def guarded_std(value: Column) -> Column:
    """Sample standard deviation, 1 where it is null or zero."""
    std = F.stddev_samp(value)
    return F.when(F.coalesce(std, F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(std)


def group_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample standard deviation and variance of a column per group."""
    number = to_double(df, value)
    return df.groupBy(*by).agg(
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.var_samp(number).alias("var"),
    )


def half_range(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: minimum, maximum and half of their distance."""
    wide = df.agg(
        *[F.min(to_double(df, n)).alias(f"min:{n}") for n in names],
        *[F.max(to_double(df, n)).alias(f"max:{n}") for n in names],
    )
    return _one_row_per_name(
        wide, names, {"min_value": "min:{}", "max_value": "max:{}"}
    ).withColumn("half_range", (F.col("max_value") - F.col("min_value")) / 2.0)


def _one_row_per_name(wide: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate with per-column fields into one row per column."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(place).alias("position"),
            *[F.col("`" + key.format(name) + "`").alias(field) for field, key in fields.items()],
        )
        for place, name in enumerate(names)
    ])
    return wide.select(F.explode(entries).alias("entry")).select("entry.*")


def group_gap(df: DataFrame, group: str, metric: str, a: object, b: object) -> DataFrame:
    """Two groups compared: means, variances, and mean gap over the pooled deviation."""
    number = to_double(df, metric)
    side = F.when(equals_value(df, group, a), "a").when(equals_value(df, group, b), "b")
    tagged = df.select(side.alias("side"), number.alias("x")).where(F.col("side").isNotNull())
    in_a, in_b = F.when(F.col("side") == "a", F.col("x")), F.when(F.col("side") == "b", F.col("x"))
    return tagged.agg(
        F.count(in_a).alias("n_a"), F.count(in_b).alias("n_b"),
        F.avg(in_a).alias("mean_a"), F.avg(in_b).alias("mean_b"),
        F.var_samp(in_a).alias("var_a"), F.var_samp(in_b).alias("var_b"),
        F.stddev_samp("x").alias("pooled_std"),
    ).withColumn(
        "mean_gap",
        F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), F.col("pooled_std")),
    )


def _t_tail(t_squared: float, dof: float) -> float:
    """P(F(1, dof) > t_squared): the regularised incomplete beta at (dof / 2, 1 / 2)."""
    if t_squared <= 0:
        return 1.0
    a, b, x = dof / 2.0, 0.5, dof / (dof + t_squared)
    swap = x >= (a + 1.0) / (a + b + 2.0)
    if swap:
        a, b, x = b, a, t_squared / (dof + t_squared)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    # Continued fraction, evaluated front to back with the ratios of its convergents.
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    tail = front * (value - 1.0)
    return 1.0 - tail if swap else tail


def levene(df: DataFrame, group: str, metric: str, a: object, b: object, **sizing) -> DataFrame:
    """Median-centred Levene test of two groups: ``(n_a, n_b, f_stat, p_value)``.

    The sums come to the driver as one row, which works out the tail probability.
    """
    side = F.when(equals_value(df, group, a), "a").when(equals_value(df, group, b), "b")
    tagged = df.select(side.alias("side"), to_double(df, metric).alias("x")).where(
        F.col("side").isNotNull() & F.col("x").isNotNull()
    )
    centres = F.broadcast(medians(tagged, ["side"], "x", **sizing))
    spread = tagged.join(centres, "side").withColumn("z", F.abs(F.col("x") - F.col("median")))
    in_a, in_b = F.when(F.col("side") == "a", F.col("z")), F.when(F.col("side") == "b", F.col("z"))
    sums = spread.agg(
        F.count(in_a).alias("n_a"), F.count(in_b).alias("n_b"),
        F.avg(in_a).alias("z_a"), F.avg(in_b).alias("z_b"), F.avg("z").alias("z_all"),
        F.var_pop(in_a).alias("v_a"), F.var_pop(in_b).alias("v_b"),
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    between = n_a * F.pow(F.col("z_a") - F.col("z_all"), 2) + n_b * F.pow(
        F.col("z_b") - F.col("z_all"), 2
    )
    within = n_a * F.col("v_a") + n_b * F.col("v_b")
    dof = (n_a + n_b - 2).cast("double")
    stat = F.try_divide(dof * between, within)
    row = sums.select("n_a", "n_b", stat.alias("f_stat"), dof.alias("dof")).first()
    known = row["f_stat"] is not None and row["dof"] > 0
    p_value = _t_tail(row["f_stat"], row["dof"]) if known else None
    return df.sparkSession.createDataFrame(
        [(row["n_a"], row["n_b"], row["f_stat"], p_value)],
        "n_a bigint, n_b bigint, f_stat double, p_value double",
    )


def group_period_means(
    df: DataFrame, group: str, time: str, split: object, outcome: str
) -> DataFrame:
    """Per group: rows and mean outcome before (a) and from (b) the split value, in one pass."""
    rows = df.select(
        F.col(group).alias("grp"),
        period_split(df, time, split).alias("period"),
        to_double(df, outcome).alias("y"),
    ).where(F.col("grp").isNotNull())
    in_a, in_b = F.col("period") == "A", F.col("period") == "B"
    return rows.groupBy("grp").agg(
        F.count_if(in_a).alias("rows_a"), F.count_if(in_b).alias("rows_b"),
        F.count(F.when(in_a, F.col("y"))).alias("n_a"),
        F.count(F.when(in_b, F.col("y"))).alias("n_b"),
        F.avg(F.when(in_a, F.col("y"))).alias("mean_a"),
        F.avg(F.when(in_b, F.col("y"))).alias("mean_b"),
    )


def trend_verdict(df: DataFrame, group: str, time: str, split: object, outcome: str) -> DataFrame:
    """Within-group and overall trend across the split, one row."""
    rows = df.select(
        F.col(group).alias("grp"),
        period_split(df, time, split).alias("period"),
        to_double(df, outcome).alias("y"),
    )
    overall = rows.agg(
        F.count_if(F.col("period") == "A").alias("rows_a"),
        F.count_if(F.col("period") == "B").alias("rows_b"),
        F.avg(F.when(F.col("period") == "A", F.col("y"))).alias("all_a"),
        F.avg(F.when(F.col("period") == "B", F.col("y"))).alias("all_b"),
    )
    means = group_period_means(df, group, time, split, outcome)
    both = (F.col("rows_a") > 0) & (F.col("rows_b") > 0)
    trends = means.where(both).agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("mean_b") > F.col("mean_a")).alias("improved"),
        F.count_if(F.col("mean_b") < F.col("mean_a")).alias("worsened"),
    )
    within = (
        F.when(F.col("groups") == 0, F.lit(None).cast("string"))
        .when(F.col("improved") == F.col("groups"), "IMPROVED")
        .when(F.col("worsened") == F.col("groups"), "WORSENED")
        .otherwise("MIXED")
    )
    total = (
        F.when(F.col("all_b") > F.col("all_a"), "IMPROVED")
        .when(F.col("all_b") < F.col("all_a"), "WORSENED")
        .otherwise("UNCHANGED")
    )
    return overall.crossJoin(F.broadcast(trends)).select(
        "rows_a", "rows_b", "groups", "improved", "worsened", "all_a", "all_b",
        within.alias("within"), total.alias("overall"),
    )


def correlations(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Pearson r of every numeric-looking feature with the target, all in one aggregate.

    Pairs with a null on either side are left out; a constant or non-numeric feature gives null.
    """
    names = features or [c for c in df.columns if c != target]
    names = [n for n in names if coercible(df, n)]
    rows = df.select(to_double(df, target).alias("y"), *[to_double(df, n).alias(n) for n in names])
    aggregates = []
    for name in names:
        x = F.col(f"`{name}`")
        y_seen = F.when(x.isNotNull(), F.col("y"))
        x_seen = F.when(F.col("y").isNotNull(), x)
        aggregates.append(
            F.try_divide(
                F.covar_samp(x, F.col("y")), F.stddev_samp(x_seen) * F.stddev_samp(y_seen)
            ).alias(f"r:{name}")
        )
    return _one_row_per_name(rows.agg(*aggregates), names, {"r": "r:{}"})


def top_k(scores: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best scored features with their rank; ties keep column order."""
    order = Window.orderBy(score.desc(), "position")  # one row per column, so always small
    return scores.where(score.isNotNull()).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k
    )


def cohens_d(df: DataFrame, outcome: str, splits: dict[str, Column]) -> DataFrame:
    """Effect size of the outcome between rows where each 0/1 split is 1 and 0, in one pass."""
    y = to_double(df, outcome)
    rows = df.select(y.alias("y"), *[bit.alias(name) for name, bit in splits.items()])
    aggregates = []
    for name in splits:
        for bit in (1, 0):
            chosen = F.when(F.col(f"`{name}`") == bit, F.col("y"))
            aggregates += [
                F.count(chosen).alias(f"n{bit}:{name}"),
                F.avg(chosen).alias(f"m{bit}:{name}"),
                F.var_samp(chosen).alias(f"v{bit}:{name}"),
            ]
    fields = {f"{s}{bit}": f"{s}{bit}:{{}}" for s in "nmv" for bit in (1, 0)}
    table = _one_row_per_name(rows.agg(*aggregates), list(splits), fields)
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0")) / (n1 + n0 - 2))
    d = F.when(
        (n1 >= 2) & (n0 >= 2), F.coalesce(F.try_divide(F.abs(F.col("m1") - F.col("m0")), pooled))
    )
    return table.select(
        F.col("feature").alias("split"), "position", "n1", "n0",
        F.col("m1").alias("mean1"), F.col("m0").alias("mean0"),
        F.coalesce(d, F.lit(0.0)).alias("d"),
    )


def auroc(
    df: DataFrame, target: str, features: list[str] | None = None, **sizing
) -> DataFrame:
    """Per feature AUROC against the target, turned upward (never below one half).

    A target with more than two values is split at its median. AUROC comes in closed form from
    the mid-ranks of the positive rows.
    """
    names = features or [c for c in df.columns if c != target]
    names = [n for n in names if coercible(df, n)]
    y = to_double(df, target)
    if distinct_reaches(df, {target: 3})[target]:
        centre = quantiles(df.select(y.alias("y")), [], "y", [0.5], **sizing).first()["quantiles"][0]
        label = F.coalesce((y >= F.lit(centre)).cast("int"), F.lit(0))
    else:
        label = y.cast("int")
    long = unpivot_numbers(df, names, {"label": label})
    table = value_ranks(
        long.where(F.col("label").isin(0, 1)), ["feature"], "x",
        [F.sum("label").alias("positives")], feature_sizes(df, names), **sizing,
    )
    sums = table.groupBy("feature").agg(
        F.sum(F.col("mid_rank") * F.col("positives")).alias("rank_sum"),
        F.sum("positives").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("n0"),
    )
    u = F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2
    area = F.try_divide(u, F.col("n1") * F.col("n0"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    return sums.select(
        "feature", place.cast("int").alias("position"), F.greatest(area, 1 - area).alias("auroc")
    ).where(F.col("auroc").isNotNull())


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact distinct values per column, counted over distinct (column, value) pairs.

    One narrow pair per cell is combined map-side and spread by both fields, where several
    ``count(DISTINCT)`` in one aggregate would shuffle a row as wide as the table for each.
    """
    places = df.select(*[
        to_double(df, n).cast("string").alias(f"@{i}") if is_number(df.schema[n].dataType)
        and not isinstance(df.schema[n].dataType, (T.LongType, T.DecimalType))
        else F.col(f"`{n}`").cast("string").alias(f"@{i}")
        for i, n in enumerate(names)
    ])
    pairs = places.unpivot([], [f"`@{i}`" for i in range(len(names))], "at", "value").where(
        F.col("value").isNotNull()
    )
    counts = pairs.groupBy("at", "value").agg(F.lit(1).alias("_")).groupBy("at").agg(
        F.count("*").alias("n_unique")
    )
    return counts.select(F.substring("at", 2, 10).cast("int").alias("position"), "n_unique")


def column_stats(df: DataFrame) -> DataFrame:
    """Per column: type, distinct and missing counts, and for numbers min, max, mean and std."""
    names = df.columns
    parts, fields = [], {}
    for name in names:
        number = is_number(df.schema[name].dataType)
        col = F.col(f"`{name}`")
        value = to_double(df, name) if number else None
        seen = value if number else col
        null = F.lit(None).cast("double")
        parts += [
            F.count_if(seen.isNull()).alias(f"n_missing:{name}"),
            (F.min(value) if number else F.max(null)).alias(f"min:{name}"),
            (F.max(value) if number else F.max(null)).alias(f"max:{name}"),
            (F.avg(value) if number else F.max(null)).alias(f"mean:{name}"),
            (F.stddev_samp(value) if number else F.max(null)).alias(f"std:{name}"),
        ]
    fields = {
        "n_missing": "n_missing:{}", "min_value": "min:{}", "max_value": "max:{}",
        "mean": "mean:{}", "std": "std:{}",
    }
    types = F.create_map(*[
        F.lit(t) for f in df.schema.fields for t in (f.name, f.dataType.simpleString())
    ])
    return _one_row_per_name(df.agg(*parts), names, fields).join(
        F.broadcast(distinct_counts(df, names)), "position", "left"  # one row per column
    ).select(
        "feature", "position", types[F.col("feature")].alias("dtype"),
        F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"), "n_missing",
        "min_value", "max_value",
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
    )


def top_values(df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column; equal counts go by value."""
    long = df.select(*[F.col(n).cast("string").alias(n) for n in names]).unpivot(
        [], names, "feature", "value"
    ).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def median_bits(df: DataFrame, names: list[str], **sizing) -> dict[str, Column]:
    """Per column: 1 above the column's median, else 0 (null counts as 0)."""
    found = {
        r["feature"]: r["median"]
        for r in medians(
            unpivot_numbers(df, names, {}), ["feature"], "x", sizes=feature_sizes(df, names), **sizing
        ).collect()
    }
    return {
        n: F.coalesce((to_double(df, n) > F.lit(found.get(n))).cast("int"), F.lit(0))
        for n in names
    }


def xor_bit(first: Column, second: Column) -> Column:
    return first.bitwiseXOR(second)
