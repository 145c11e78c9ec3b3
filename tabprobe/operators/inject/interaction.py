"""Interaction phenomenon: the outcome follows the XOR of two features above their medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.draws import shuffled
from tabprobe.functions.numbers import round_even, to_double, typical_decimals
from tabprobe.operators.columns import numeric_features
from tabprobe.operators.inject.base import Injection, or_one, replace_column
from tabprobe.operators.moments import correlations, median_bits, xor_bit
from tabprobe.operators.pairs import xor_effects
from tabprobe.sources.shared import cut

MIN_UNIQUE = 5
MIN_EFFECT = 0.5
MAX_MAIN = 0.7


def interaction_dominant(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    outcome = params["outcome_col"]
    strength = float(params.get("effect_strength", 1.5))
    done = Injection("ix_interaction_dominant", df, params)
    names = numeric_features(df, outcome, MIN_UNIQUE)
    if len(names) < 3:
        return done.reject(f"needs three numeric features, found {len(names)}")
    first, second = shuffled(names, seed, "pair")[:2]
    bits = median_bits(df, names)
    signal = xor_bit(bits[first], bits[second])
    y = to_double(df, outcome)
    found = df.agg(
        F.stddev_samp(y).alias("std"), F.avg(signal).alias("level"),
        F.avg(y).alias("mean"), typical_decimals(y).alias("places"),
    ).first()
    amplitude = strength * or_one(found["std"])
    value = y + F.lit(amplitude) * (signal - F.lit(found["level"]))
    done.table = replace_column(df, outcome, round_even(value, found["places"]))
    done.effects = {"feat_a": first, "feat_b": second, "amplitude": amplitude}
    # The injected pair against every other pair, all of them in one scan.
    effects = cut(xor_effects(
        done.table, to_double(done.table, outcome), [bits[n] for n in names], found["mean"] or 0.0))
    a, b = sorted((names.index(first), names.index(second)))
    is_own = (F.col("a") == a) & (F.col("b") == b)
    own = effects.agg(F.max(F.when(is_own, F.col("d")))).first()[0] or 0.0
    if own < MIN_EFFECT:
        return done.reject(f"effect size {own:.4f} is too small")
    mains = correlations(done.table, outcome, [first, second]).collect()
    for row in mains:
        if row["r"] is not None and abs(row["r"]) > MAX_MAIN:
            return done.reject(f"feature {row['feature']} has a main effect of its own")
    rival = effects.where(~is_own & (F.col("d") >= own)).orderBy("a", "b").first()
    if rival:
        return done.reject(
            f"pair {names[rival['a']]}, {names[rival['b']]} interacts at least as strongly")
    return done
