"""Quantile bins of features and the shape of the outcome across them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.numbers import to_double
from tabprobe.operators.columns import unpivot_numbers
from tabprobe.operators.ranks import feature_sizes, quantiles


def quantile_edges(df: DataFrame, features: list[str], q: int = 5, **sizing) -> DataFrame:
    """Per feature: the distinct bin edges at the q-quantiles."""
    probs = [i / q for i in range(q + 1)]
    long = unpivot_numbers(df, features, {})
    return quantiles(
        long, ["feature"], "x", probs, feature_sizes(df, features), **sizing
    ).select("feature", F.array_distinct("quantiles").alias("edges"))


def bin_of(value: Column, edges: Column, q: int) -> Column:
    """1-based bin: intervals are open on the left, the first one holds the minimum too.

    There are at most q + 1 edges, so plain comparisons are used; they stay in generated code.
    """
    passed = [F.when(F.get(edges, F.lit(i)) < value, 1).otherwise(0) for i in range(1, q + 1)]
    return F.lit(1) + reduce(lambda a, b: a + b, passed)


def assign_bins(
    df: DataFrame, features: list[str], edges: DataFrame, carry: dict[str, Column], q: int = 5
) -> DataFrame:
    """One row per (row, feature) with the feature's bin; features with one edge have no bins.

    ``edges`` holds one short array per column of the table, so it is small by construction.
    """
    long = unpivot_numbers(df, features, carry)
    return long.join(F.broadcast(edges.where(F.size("edges") > 1)), "feature").withColumn(
        "bin", bin_of(F.col("x"), F.col("edges"), q)
    )


def bin_means(
    df: DataFrame, outcomes: dict[str, Column], features: list[str], edges: DataFrame, q: int = 5
) -> DataFrame:
    """Mean of each outcome per (feature, bin), long form: ``(feature, outcome, bin, n, mean)``."""
    binned = assign_bins(df, features, edges, outcomes, q)
    wide = binned.groupBy("feature", "bin").agg(*[
        F.struct(F.lit(name).alias("outcome"), F.count(f"`{name}`").alias("n"),
                 F.avg(f"`{name}`").alias("mean")).alias(f"o{i}")
        for i, name in enumerate(outcomes)
    ])
    entries = F.array(*[F.col(f"o{i}") for i in range(len(outcomes))])
    return wide.select("feature", "bin", F.explode(entries).alias("entry")).select(
        "feature", "entry.outcome", "bin", "entry.n", "entry.mean"
    )


def shape_scores(means: DataFrame) -> DataFrame:
    """Per (feature, outcome): peak, rank correlation and reversal of the bin means.

    * ``peak_score``: best inner mean minus the lower outer mean, 0 under three bins;
    * ``peak_inside``: whether the highest mean lies in neither outer bin;
    * ``rho``: Spearman correlation of bin and mean, 1 where undefined or under three bins;
    * ``reversal``: whether the means turn direction at least once.

    ``means`` has at most q rows per (feature, outcome).
    """
    of = Window.partitionBy("feature", "outcome")
    along = of.orderBy("bin")
    by_mean = of.orderBy("mean")
    ranked = means.select(
        "*",
        F.row_number().over(along).alias("at"),
        F.count("*").over(of).alias("bins"),
        (F.rank().over(by_mean)
         + (F.count("*").over(of.partitionBy("feature", "outcome", "mean")) - 1) / 2.0
         ).alias("mean_rank"),
        F.signum(F.col("mean") - F.lag("mean").over(along)).alias("turn"),
    ).withColumn("next_turn", F.lead("turn").over(along))
    inner = (F.col("at") > 1) & (F.col("at") < F.col("bins"))
    outer = (F.col("at") == 1) | (F.col("at") == F.col("bins"))
    turned = (
        (F.col("turn") != 0) & (F.col("next_turn") != 0) & (F.col("turn") != F.col("next_turn"))
    )
    table = ranked.groupBy("feature", "outcome").agg(
        F.max("bins").alias("bins"),
        F.max(F.when(inner, F.col("mean"))).alias("inner_max"),
        F.min(F.when(outer, F.col("mean"))).alias("outer_min"),
        F.max_by("at", F.struct("mean", -F.col("at"))).alias("peak_at"),
        F.try_divide(
            F.covar_pop(F.col("at").cast("double"), F.col("mean_rank")),
            F.stddev_pop("at") * F.stddev_pop("mean_rank"),
        ).alias("rank_r"),
        F.count_if(F.col("mean").isNull()).alias("unknown"),
        F.coalesce(F.bool_or(turned), F.lit(False)).alias("turned"),
    )
    enough = F.col("bins") >= 3
    return table.select(
        "feature", "outcome", "bins",
        F.when(enough, F.col("inner_max") - F.col("outer_min")).otherwise(0.0).alias("peak_score"),
        (enough & (F.col("peak_at") > 1) & (F.col("peak_at") < F.col("bins"))).alias("peak_inside"),
        F.when(enough & (F.col("unknown") == 0), F.coalesce(F.round("rank_r", 10), F.lit(1.0))
               ).otherwise(1.0).alias("rho"),
        (enough & F.col("turned")).alias("reversal"),
    )


def shapes_of(df: DataFrame, outcome: str, features: list[str], q: int = 5, **sizing) -> DataFrame:
    """Shape scores of every feature against one outcome column."""
    edges = quantile_edges(df, features, q, **sizing)
    return shape_scores(bin_means(df, {outcome: to_double(df, outcome)}, features, edges, q))
