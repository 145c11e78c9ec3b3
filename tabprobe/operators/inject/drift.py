"""Root-cause phenomena: Simpson's paradox across a date, and a change point in a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.draws import draw_n, shuffled
from tabprobe.functions.numbers import (
    number_columns, period_split, round_even, to_double, typed_literal, typical_decimals,
)
from tabprobe.operators.inject.base import Injection, or_one, replace_column
from tabprobe.operators.moments import median_bits, xor_bit
from tabprobe.operators.ranks import order_statistics

BROADCAST_GROUPS = 10_000
#: Up to so many groups are also named in the effects; `groups` always has all of them.
LISTED_GROUPS = 1_000


def performance_improve(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """Make every group improve across the split while the whole table worsens.

    One group x period aggregate gives each group's shift, the composition gap that is left once
    every group is level, and half of that gap as the common rise, all in closed form.
    """
    outcome, group = params["outcome_col"], params["group_col"]
    time, split = params["time_col"], params["specific_date"]
    done = Injection("rca_performance_improve", df, params)
    y = to_double(df, outcome)
    period = period_split(df, time, split)
    in_a, in_b = F.col("period") == "A", F.col("period") == "B"
    stats = df.select(F.col(group).alias("grp"), period.alias("period"), y.alias("y")).groupBy(
        "grp"
    ).agg(
        F.count_if(in_a).alias("rows_a"), F.count_if(in_b).alias("rows_b"),
        F.count(F.when(in_a, F.col("y"))).alias("n_a"),
        F.count(F.when(in_b, F.col("y"))).alias("n_b"),
        F.avg(F.when(in_a, F.col("y"))).alias("mean_a"),
        F.avg(F.when(in_b, F.col("y"))).alias("mean_b"),
        F.count(F.when(in_a | in_b, F.lit(None)).otherwise(F.col("y"))).alias("n_none"),
        F.sum(F.when(in_a | in_b, F.lit(None)).otherwise(F.col("y"))).alias("sum_none"),
    )
    both = F.col("grp").isNotNull() & (F.col("rows_a") > 0) & (F.col("rows_b") > 0)
    stats = stats.withColumn(
        "shift",
        F.when(both, F.coalesce(F.col("mean_a") - F.col("mean_b"), F.lit(0.0))).otherwise(0.0),
    )
    level_b = F.col("mean_b") + F.col("shift")
    found = stats.agg(
        F.count("*").alias("groups"), F.sum("rows_a").alias("rows_a"),
        F.sum("rows_b").alias("rows_b"), F.count_if(both).alias("comparable"),
        F.try_divide(F.sum(F.col("n_a") * F.col("mean_a")), F.sum("n_a")).alias("all_a"),
        F.try_divide(F.sum(F.col("n_b") * level_b), F.sum("n_b")).alias("level_b"),
    ).first()
    if found["groups"] < 2:
        return done.reject("fewer than two groups")
    if not found["rows_a"] or not found["rows_b"]:
        return done.reject("one period is empty")
    if found["all_a"] is None or found["level_b"] is None:
        return done.reject(f"column {outcome} has no numbers in one period")
    gap = found["all_a"] - found["level_b"]
    rise = gap * 0.5
    shifts = stats.select(F.col("grp"), F.col("shift"))
    if found["groups"] <= BROADCAST_GROUPS:
        shifts = F.broadcast(shifts)
    joined = df.join(shifts, df[group] == F.col("grp"), "left")
    value = F.when(
        period == "B", y + F.coalesce(F.col("shift"), F.lit(0.0)) + F.lit(rise)
    ).otherwise(y)
    done.table = joined.select(*[
        value.alias(c) if c == outcome else df[c] for c in df.columns
    ])
    means = stats.where(F.col("grp").isNotNull()).select(
        F.col("grp").cast("string").alias("grp"),
        F.try_divide(
            F.col("n_a") * F.coalesce("mean_a", F.lit(0.0))
            + F.col("n_b") * (F.coalesce(level_b, F.lit(0.0)) + F.lit(rise))
            + F.coalesce("sum_none", F.lit(0.0)),
            F.col("n_a") + F.col("n_b") + F.col("n_none"),
        ).alias("mean"),
    ).where(F.col("mean").isNotNull()).select("grp", F.struct("mean", "grp").alias("place"))
    # The middle group in (mean, name) order divides low from high.
    middle = order_statistics(
        means, [], "place", means.agg(F.floor(F.count("*") / 2).cast("bigint").alias("k"))
    ).select(F.col("place").alias("middle"))
    done.groups = means.crossJoin(F.broadcast(middle)).select(
        "grp", "place.mean",
        F.when(F.col("place") < F.col("middle"), "low").otherwise("high").alias("side"),
    )
    done.effects = {
        "split_point": str(split), "group_col": group, "n_groups": found["groups"],
        "epsilon": rise, "composition_gap": gap, "paradox_verified": gap > 0,
    }
    if gap <= 0:
        return done.reject("groups with high means are not over-represented in period A")
    if found["comparable"] == 0:
        return done.reject("no group has rows in both periods")
    if found["groups"] <= LISTED_GROUPS:
        listed = done.groups.orderBy("mean", "grp").collect()
        done.effects["low_groups"] = [r["grp"] for r in listed if r["side"] == "low"]
        done.effects["high_groups"] = [r["grp"] for r in listed if r["side"] == "high"]
    return done


def retrain_point(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """From one row id on, make the score depend on the XOR of two features, mean unchanged."""
    score, order, start = params["pred_col"], params["order_col"], params["specific_row_id"]
    done = Injection("rca_retrain_point", df, params)
    names = [n for n in number_columns(df) if n not in (score, order)]
    if len(names) < 2:
        done.effects = {"change_row_id": None}
        return done
    first, second = shuffled(names, seed, "pair")[:2]
    bits = median_bits(df, [first, second])
    signal = xor_bit(bits[first], bits[second])
    y = to_double(df, score)
    post = F.coalesce(F.col(f"`{order}`") >= typed_literal(df, order, start), F.lit(False))
    found = df.select(y.alias("y"), post.alias("post"), signal.alias("signal")).agg(
        F.count_if("post").alias("n_post"),
        F.avg(F.when(~F.col("post"), F.col("y"))).alias("mean"),
        F.avg("y").alias("mean_all"),
        F.stddev_samp(F.when(~F.col("post"), F.col("y"))).alias("std"),
        F.avg(F.when(F.col("post"), F.col("signal"))).alias("level"),
        typical_decimals(F.when(~F.col("post"), F.col("y"))).alias("places"),
    ).first()
    mean = found["mean_all"] if found["mean"] is None else found["mean"]
    if mean is None:
        return done.reject(f"column {score} has no numbers")
    std = or_one(found["std"])
    effect = std * 1.5
    value = (
        F.lit(mean) + (signal - F.lit(found["level"] or 0.0)) * F.lit(effect)
        + draw_n(seed, "noise", key) * F.lit(std * 0.2)
    )
    done.table = replace_column(
        df, score, F.when(post, round_even(value, found["places"])).otherwise(y)
    )
    done.effects = {
        "change_row_id": str(start), "n_rows_changed": found["n_post"],
        "feat_a": first, "feat_b": second, "effect_size": effect,
    }
    return done
