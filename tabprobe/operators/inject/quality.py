"""Data-quality phenomena: a riskier group, and a flag column that marks corrupted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.draws import draw_n, u_text
from tabprobe.functions.numbers import equals_value, is_whole, to_double
from tabprobe.operators.columns import anonymize_columns, insert_column, insertion
from tabprobe.operators.inject.base import Injection, or_one, replace_column
from tabprobe.operators.moments import group_gap
from tabprobe.operators.sampling import in_sample, sample_cutoff

MAX_GAP = 0.5


def riskier_group(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """Give two groups the same mean and very different spread."""
    group, metric = params["group_col"], params["metric_col"]
    a, b = params["group_a"], params["group_b"]
    strength = float(params.get("std_multiplier", 5.0))
    risky, safe = (a, b) if u_text(seed, "coin", "") < 0.5 else (b, a)
    y = to_double(df, metric)
    found = df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std")).first()
    done = Injection("dq_riskier_group", df, params)
    if found["mean"] is None:
        return done.reject(f"column {metric} has no numbers")
    mean, std = found["mean"], or_one(found["std"])
    noise = draw_n(seed, "risk", key)
    value = (
        F.when(equals_value(df, group, risky), F.lit(mean) + noise * F.lit(std * strength))
        .when(equals_value(df, group, safe), F.lit(mean) + noise * F.lit(std * 0.5))
        .otherwise(y)
    )
    done.table = replace_column(df, metric, value)
    done.effects = {
        "risky_group": str(risky), "safe_group": str(safe),
        "std_multiplier": strength, "global_mean": mean,
    }
    gap = group_gap(done.table, group, metric, risky, safe).first()["mean_gap"]
    if gap is not None and gap > MAX_GAP:
        return done.reject(f"group means {gap:.4f} pooled deviations apart")
    return done


def bad_row_indicator(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """Raise the outcome of a random tenth of the rows and flag them in a new column.

    The flagged rows are the ones whose indicator is 1 in the returned table; they are never
    listed on the driver.
    """
    outcome = params["outcome_col"]
    fraction = float(params.get("bad_fraction", 0.1))
    cap = float(params.get("corruption_cap_std", 2.0))
    y = to_double(df, outcome)
    found = df.agg(
        F.count("*").alias("rows"), F.count(F.col(f"`{outcome}`")).alias("raw"),
        F.count(y).alias("n"), F.stddev_samp(y).alias("std"), F.bool_and(is_whole(y)).alias("whole"),
    ).first()
    done = Injection("dq_bad_row_indicator", df, params)
    if found["n"] == 0 or found["n"] < found["raw"]:
        return done.reject(f"column {outcome} is not numeric")
    n_bad = max(1, int(found["rows"] * fraction))
    std = or_one(found["std"])
    bad = in_sample(sample_cutoff(df, key, n_bad, seed, "bad"), key, seed, "bad")
    noise = F.least(F.abs(draw_n(seed, "noise", key) * F.lit(std * 0.5)), F.lit(std * cap))
    raised = F.rint(y + noise) if found["whole"] else y + noise
    name, position = insertion(df.columns, seed)
    marked = insert_column(df, name, F.when(bad, 1).otherwise(0), position)
    done.table = replace_column(marked, outcome, F.when(F.col(name) == 1, raised).otherwise(y))
    done.effects = {
        "indicator_col": name, "n_bad_rows": n_bad,
        "bad_fraction": fraction, "corruption_cap_std": cap,
    }
    return done


def bad_row_indicator_v1(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    """The same, with every column but the outcome and the ids renamed to five random letters."""
    done = bad_row_indicator(df, params, seed, key)
    done.injector = "dq_bad_row_indicator_v1"
    if done.status != "OK":
        return done
    keep = [params["outcome_col"], *params.get("id_no_cols", [])]
    done.table, mapping = anonymize_columns(done.table, keep, seed)
    done.effects["indicator_col"] = mapping[done.effects["indicator_col"]]
    return done
