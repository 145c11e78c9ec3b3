"""Shape phenomena: an inverted U and a valley in one feature's relation to the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.draws import shuffled, u_text
from tabprobe.functions.numbers import round_even, to_double, typical_decimals
from tabprobe.operators.columns import id_like, numeric_features, unpivot_numbers
from tabprobe.operators.inject.base import Injection, or_one, replace_column
from tabprobe.operators.ranks import feature_sizes, quantiles
from tabprobe.operators.shapes import bin_means, quantile_edges, shape_scores

MIN_UNIQUE = 10
MONOTONE_RHO = 0.6
REVERSED_RHO = 0.5


def _ranges(df: DataFrame, outcome: str, names: list[str]):
    """Spread and decimals of the outcome, and range and decimals of each feature, in one pass."""
    y = to_double(df, outcome)
    return df.agg(
        F.stddev_samp(y).alias("std"), typical_decimals(y).alias("places"),
        *[
            F.struct(
                F.min(to_double(df, n)).alias("low"), F.max(to_double(df, n)).alias("high"),
                typical_decimals(to_double(df, n)).alias("places"),
            ).alias(f"f{i}")
            for i, n in enumerate(names)
        ],
    ).first()


def nonmonotone_peak(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """Add an inverted U over one random feature."""
    outcome = params["outcome_col"]
    strength = float(params.get("effect_strength", 2.0))
    done = Injection("sf_nonmonotone_peak", df, params)
    names = numeric_features(df, outcome, MIN_UNIQUE)
    if len(names) < 2:
        return done.reject(f"needs two numeric features, found {len(names)}")
    chosen = shuffled(names, seed, "feature")[0]
    x, y = to_double(df, chosen), to_double(df, outcome)
    at = 0.35 + 0.3 * u_text(seed, "peak", "")
    found = _ranges(df, outcome, [chosen])
    raw = quantiles(
        df.select(x.alias("x")), [], "x", [at], feature_sizes(df, [chosen])
    ).first()["quantiles"][0]
    peak = round(raw, found["f0"]["places"])
    half = (found["f0"]["high"] - found["f0"]["low"]) / 2.0
    if half == 0:
        return done.reject(f"feature {chosen} is constant")
    std = or_one(found["std"])
    amplitude = strength * std
    distance = (x - F.lit(peak)) / F.lit(half)
    # A row without the feature has no place on the curve and so no outcome.
    value = round_even(y + F.lit(amplitude) * (F.lit(1.0) - distance * distance), found["places"])
    done.table = replace_column(df, outcome, value)
    done.effects = {
        "peak_feature": chosen, "peak_value": peak, "amplitude": amplitude, "half_range": half,
    }
    edges = quantile_edges(df, names)
    means = bin_means(done.table, {outcome: to_double(done.table, outcome)}, names, edges)
    scores = {r["feature"]: r for r in shape_scores(means).collect()}
    own = scores.get(chosen)
    if own is None or own["bins"] < 3:
        return done.reject(f"feature {chosen} has fewer than three bins")
    if not own["peak_inside"]:
        return done.reject(f"highest bin of {chosen} is an outer one")
    if own["peak_score"] < 0.5 * std:
        return done.reject(f"curve over {chosen} is too flat")
    stronger = sorted(
        n for n, r in scores.items() if n != chosen and (r["peak_score"] or 0) >= own["peak_score"]
    )
    if stronger:
        return done.reject(f"feature {stronger[0]} has a stronger curve than {chosen}")
    return done


def monotone_classify(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """Cut a valley into one so far monotone feature and make it the least monotone of all.

    Every candidate's trial outcome is binned over every feature in one aggregate; the first
    candidate in random order that passes all checks is kept.
    """
    outcome = params["outcome_col"]
    strength = float(params.get("effect_strength", 3.0))
    done = Injection("sf_monotone_classify", df, params)
    names = numeric_features(df, outcome, MIN_UNIQUE)
    ids = id_like(df, names, key) if key in df.columns else set()
    names = [n for n in names if n not in ids]
    if len(names) < 3:
        return done.reject(f"needs three numeric features, found {len(names)}")
    y = to_double(df, outcome)
    # The edges do not depend on the outcome; a few numbers per column are fetched once.
    edge_rows = [(r["feature"], r["edges"]) for r in quantile_edges(df, names).collect()]
    edges = df.sparkSession.createDataFrame(edge_rows, "feature string, edges array<double>")
    before = {
        r["feature"]: r["rho"]
        for r in shape_scores(bin_means(df, {outcome: y}, names, edges)).collect()
    }
    candidates = [n for n in names if abs(before.get(n, 1.0)) >= MONOTONE_RHO]
    if not candidates:
        return done.reject("no feature is clearly monotone")
    candidates = shuffled(candidates, seed, "candidate")
    found = _ranges(df, outcome, candidates)
    centres = {
        r["feature"]: r["quantiles"][0]
        for r in quantiles(
            unpivot_numbers(df, candidates, {}), ["feature"], "x", [0.5],
            feature_sizes(df, candidates),
        ).collect()
    }
    amplitude = strength * or_one(found["std"])
    trials, facts = {}, {}
    for i, name in enumerate(candidates):
        half = (found[f"f{i}"]["high"] - found[f"f{i}"]["low"]) / 2.0
        if half == 0:
            continue
        middle = round(centres[name], found[f"f{i}"]["places"])
        away = F.abs((to_double(df, name) - F.lit(middle)) / F.lit(half))
        trials[name] = round_even(y - F.lit(amplitude) * (F.lit(1.0) - away), found["places"])
        facts[name] = (middle, half)
    if not trials:
        return done.reject("every candidate is constant")
    scores = {
        (r["outcome"], r["feature"]): r
        for r in shape_scores(bin_means(df, trials, names, edges)).collect()
    }
    reason = ""
    for name in trials:
        own = scores.get((name, name))
        rho = 1.0 if own is None else abs(own["rho"])
        rivals = [
            n for n in names if n != name
            and abs(scores[(name, n)]["rho"] if (name, n) in scores else 1.0) <= rho
        ]
        if rho >= REVERSED_RHO:
            reason = f"{name} is still monotone"
        elif not own["reversal"]:
            reason = f"{name} never turns"
        elif rivals:
            reason = f"{rivals[0]} is at least as non-monotone as {name}"
        else:
            done.table = replace_column(df, outcome, trials[name])
            done.effects = {
                "injected_feature": name, "midpoint": facts[name][0],
                "amplitude": amplitude, "half_range": facts[name][1],
            }
            return done
    return done.reject(f"no candidate passed; last: {reason}")
