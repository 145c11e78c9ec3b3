"""Ground-truth answers, recomputed from the table and checked against the injected truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions.numbers import number_columns, to_double
from tabprobe.operators.columns import id_like, numeric_features
from tabprobe.operators.moments import (
    auroc, cohens_d, correlations, group_gap, levene, median_bits, top_k, trend_verdict, xor_bit,
)
from tabprobe.operators.shapes import shapes_of

MAX_GAP = 0.5
ALPHA = 0.05


class Unanswerable(Exception):
    """The data do not bear out the injected phenomenon."""


@dataclass
class Answer:
    value: str | list[str] | None
    status: str
    reason: str = ""


def _ids(effects: dict) -> list[str]:
    return effects.get("fi_top_features", {}).get("id_no_cols", [])


def _features(df: DataFrame, slots: dict, effects: dict) -> list[str]:
    skip = {slots["OUTCOME_COL"], *_ids(effects)}
    return [c for c in df.columns if c not in skip]


def top_by_correlation(df: DataFrame, slots: dict, effects: dict, key: str) -> list[str]:
    scores = correlations(df, slots["OUTCOME_COL"], _features(df, slots, effects))
    best = top_k(scores, F.abs(F.col("r")), int(slots.get("K", 5)))
    return [r["feature"] for r in best.orderBy("rank").collect()]


def top_by_auroc(df: DataFrame, slots: dict, effects: dict, key: str) -> list[str]:
    scores = auroc(df, slots["OUTCOME_COL"], _features(df, slots, effects))
    best = top_k(scores, F.col("auroc"), int(slots.get("K", 5)))
    return [r["feature"] for r in best.orderBy("rank").collect()]


def bad_row_column(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    found = effects.get("dq_bad_row_indicator") or effects.get("dq_bad_row_indicator_v1")
    if not found:
        raise Unanswerable("no bad-row effect")
    return found["indicator_col"]


def indicator_by_data(df: DataFrame, outcome: str) -> str | None:
    """The 0/1 column that sets the outcome apart most (by Cohen's d), or None without one.

    What an analyst finds who is not told which column was put in; ties go to the first column.
    """
    names = [n for n in number_columns(df) if n != outcome]
    if not names:
        return None
    zero_or_one = df.agg(*[
        (F.bool_and(to_double(df, n).isin(0.0, 1.0)) & (F.min(to_double(df, n)) == 0.0)
         & (F.max(to_double(df, n)) == 1.0)).alias(f"c{i}") for i, n in enumerate(names)
    ]).first()
    flags = [n for i, n in enumerate(names) if zero_or_one[i]]
    if not flags:
        return None
    sizes = cohens_d(df, outcome, {n: to_double(df, n).cast("int") for n in flags})
    return sizes.orderBy(F.desc("d"), "position").first()["split"]


def riskier_group(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    """The group with the larger variance, given close means and a significant Levene test."""
    group, metric = slots["GROUP_COL"], slots["RISK_METRIC_COL"]
    a, b = slots["GROUP_A"], slots["GROUP_B"]
    gap = group_gap(df, group, metric, a, b).first()
    if not gap["pooled_std"]:
        raise Unanswerable(f"column {metric} is constant over both groups")
    if gap["mean_gap"] is not None and gap["mean_gap"] > MAX_GAP:
        raise Unanswerable("group means differ")
    p_value = levene(df, group, metric, a, b).first()["p_value"]
    if p_value is not None and p_value > ALPHA:
        raise Unanswerable("variances do not differ")
    riskier = a if (gap["var_a"] or 0) > (gap["var_b"] or 0) else b
    if str(riskier) != str(effects["dq_riskier_group"]["risky_group"]):
        raise Unanswerable(f"group {riskier} varies more than the injected one")
    return str(riskier)


def retrain_point(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    start = effects["rca_retrain_point"]["change_row_id"]
    return "NO" if start is None else f"YES, {start}"


def performance_improved(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    effects["rca_performance_improve"]
    found = trend_verdict(
        df, slots["GROUP_COL"], slots["TIME_COL"], slots["SPECIFIC_DATE"], slots["OUTCOME_COL"]
    ).first()
    if not found["rows_a"] or not found["rows_b"]:
        raise Unanswerable("one period is empty")
    if not found["groups"]:
        raise Unanswerable("no group has rows in both periods")
    if found["within"] != "IMPROVED" or found["overall"] != "WORSENED":
        raise Unanswerable(f"groups: {found['within']}, whole table: {found['overall']}")
    return found["within"]


def peak_feature(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    truth = effects["sf_nonmonotone_peak"]
    shape = shapes_of(df, slots["OUTCOME_COL"], [truth["peak_feature"]]).first()
    if shape is None or not shape["peak_inside"]:
        raise Unanswerable(f"highest bin of {truth['peak_feature']} is an outer one")
    return f"{truth['peak_feature']}, {truth['peak_value']}"


def dominant_pair(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    truth = effects["ix_interaction_dominant"]
    pair = sorted([truth["feat_a"], truth["feat_b"]])
    bits = median_bits(df, pair)
    found = cohens_d(df, slots["OUTCOME_COL"], {"pair": xor_bit(bits[pair[0]], bits[pair[1]])}).first()
    if found["mean1"] is None or found["mean0"] is None or found["mean1"] <= found["mean0"]:
        raise Unanswerable("the pair's XOR does not raise the outcome")
    return ", ".join(pair)


def least_monotone(df: DataFrame, slots: dict, effects: dict, key: str) -> str:
    outcome = slots["OUTCOME_COL"]
    truth = effects["sf_monotone_classify"]["injected_feature"]
    names = numeric_features(df, outcome, 10)
    ids = id_like(df, names, key) if key in df.columns else set()
    names = [n for n in names if n not in ids]
    rho = {r["feature"]: abs(r["rho"]) for r in shapes_of(df, outcome, names).collect()}
    lowest = min(names, key=lambda n: rho.get(n, 1.0), default=None)
    if lowest != truth:
        raise Unanswerable(f"{lowest} is less monotone than {truth}")
    return truth


ANSWERS = {
    "fi_top_features_v0": top_by_correlation,
    "fi_top_features_v1": top_by_auroc,
    "dq_bad_row_indicator_v0": bad_row_column,
    "dq_bad_row_indicator_v1": bad_row_column,
    "dq_riskier_group_v0": riskier_group,
    "dq_riskier_group_v1": riskier_group,
    "dq_riskier_group_v2": riskier_group,
    "rca_retrain_point_v0": retrain_point,
    "rca_performance_improve_v0": performance_improved,
    "rca_performance_improve_v1": performance_improved,
    "sf_nonmonotone_peak_v0": peak_feature,
    "ix_interaction_dominant_v0": dominant_pair,
    "sf_monotone_classify_v0": least_monotone,
}


def answer_safe(
    template_id: str, df: DataFrame, slots: dict, effects: dict, key: str = "row_id"
) -> Answer:
    """The answer with its status: OK, SKIP (no such template) or ERROR (with the reason)."""
    compute = ANSWERS.get(template_id)
    if compute is None:
        return Answer(None, "SKIP", "no answer for this template")
    try:
        return Answer(compute(df, slots, effects, key), "OK")
    except Unanswerable as exc:
        return Answer(None, "ERROR", str(exc))
    except KeyError as exc:
        return Answer(None, "ERROR", f"missing {exc}")
