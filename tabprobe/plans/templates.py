"""The question templates, as data.

A template has typed slots, a feature pool, the phenomena that make its question answerable, and
requirements on the table. Texts, limits and defaults are fixed values.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

NUMBER = ["int", "float"]
POOL = {"exclude_target": True, "exclude_kinds": ["id_no"], "exclude_dtypes": ["empty"]}
BARE_POOL = {"exclude_target": True, "exclude_kinds": ["id_no"], "exclude_dtypes": []}

SCHEMA = """
    template_id string, category string, answer_format string, question string,
    slots array<struct<
        slot: string, type: string, source: string, source_column: string, position: string,
        kind_any_of: array<string>, dtype_any_of: array<string>,
        unique_count_min: bigint, unique_count_max: bigint, default: string, min: string, max: string>>,
    feature_pool struct<
        exclude_target: boolean, exclude_kinds: array<string>, exclude_dtypes: array<string>>,
    phenomena array<struct<injector: string, param_mapping: map<string,string>>>,
    requirements array<struct<
        type: string, kind: string, dtype: string, dtypes: array<string>, min: bigint>>
"""


def column(slot: str, kinds: list[str], dtypes: list[str] | None = None, **limits) -> dict:
    return {"slot": slot, "type": "column", "kind_any_of": kinds, "dtype_any_of": dtypes, **limits}


def target(slot: str, kinds: list[str], dtypes: list[str] | None = None, **limits) -> dict:
    return column(slot, kinds, dtypes, source="dataset.target", **limits)


def value(slot: str, of: str, type_: str = "string", position: str = "random") -> dict:
    return {
        "slot": slot, "type": type_, "source": "column_values", "source_column": of,
        "position": position,
    }


def scalar(
    slot: str, type_: str, default: str, low: str | None = None, high: str | None = None
) -> dict:
    return {"slot": slot, "type": type_, "default": default, "min": low, "max": high}


def features(least: int) -> dict:
    return {"type": "min_feature_count", "min": least}


def _template(
    template_id: str, category: str, answer_format: str, question: str, slots: list[dict],
    injector: str, params: dict[str, str], requirements: list[dict], pool: dict = POOL,
) -> dict:
    return {
        "template_id": template_id, "category": category, "answer_format": answer_format,
        "question": question, "slots": slots, "feature_pool": pool,
        "phenomena": [{"injector": injector, "param_mapping": params}],
        "requirements": requirements,
    }


# Categories and questions.
QUALITY = "Data Quality / Feature Semantics"
IMPORTANCE = "Feature Importance Ranking"
SHAPE = "Shape Function Interpretation"
INTERACTION = "Interaction Detection"
CAUSE = "Root Cause Analysis"

Q_RISK = (
    "Between groups {GROUP_A} and {GROUP_B} (defined by {GROUP_COL}), which group should be "
    "treated as higher risk with respect to {RISK_METRIC_COL}? Return exactly one group name."
)
Q_FILTER = (
    "You can apply exactly one rule based on a single column to exclude problematic rows before "
    "analyzing {OUTCOME_COL}. Which column should the rule be based on? Return a single column "
    "name."
)
Q_PEARSON = (
    "Which columns have the highest absolute Pearson correlation with {OUTCOME_COL}? Return up to "
    "{K} feature names, ranked from highest to lowest correlation, as a comma-separated list "
    "(e.g. col_a, col_b, col_c)."
)
Q_AUROC = (
    "You want to build a binary classifier to predict {OUTCOME_COL} and maximize AUROC. Which {K} "
    "features are most predictive? Return feature names ranked from most to least predictive as a "
    "comma-separated list (e.g. col_a, col_b, col_c)."
)
Q_PEAK = (
    "One feature has an inverted-U relationship with {OUTCOME_COL} — performance peaks at a "
    "specific value and declines on both sides. Which feature, and at what value is the peak? "
    "Return your answer as: column_name, value"
)
Q_MONOTONE = (
    "For each numeric feature, classify its relationship with {OUTCOME_COL} as MONOTONE "
    "(consistently increasing or decreasing) or NON-MONOTONE (changes direction at least once). "
    "Which feature has the most non-monotone relationship with the outcome? Return only the "
    "feature name."
)
Q_PAIR = (
    "Which pair of features has the strongest interaction effect on {OUTCOME_COL}? Return the two "
    "column names as: column_a, column_b"
)
Q_TREND = (
    "Between period A and period B (defined by before and after {SPECIFIC_DATE} in {TIME_COL}), "
    "did {OUTCOME_COL} improve, worsen, or stay about the same? Return exactly one of: IMPROVED, "
    "WORSENED, UNCHANGED."
)
Q_SEGMENTS = (
    "For each segment defined by {GROUP_COL}, did {OUTCOME_COL} improve, worsen, or stay about the "
    "same between period A (before {SPECIFIC_DATE} in {TIME_COL}) and period B? Return exactly one "
    "of: IMPROVED, WORSENED, UNCHANGED."
)
Q_RETRAIN = (
    "Column {OUTCOME_COL} is a model's output score over the rows in this table. Should the model "
    "be retrained? If NO, return exactly: NO. If YES, return exactly: YES, <value> where <value> "
    "is the earliest {ORDER_COL} value after which retraining is warranted (e.g. YES, 42)."
)


def _riskier(version: int, multiplier: str) -> dict:
    return _template(
        f"dq_riskier_group_v{version}", QUALITY, "categorical", Q_RISK,
        [
            column("GROUP_COL", ["binary", "categorical"], ["bool", "int", "string"],
                   unique_count_min=2),
            target("RISK_METRIC_COL", ["regression"], NUMBER, unique_count_min=2),
            value("GROUP_A", "GROUP_COL"), value("GROUP_B", "GROUP_COL"),
            scalar("STD_MULTIPLIER", "float", multiplier),
        ],
        "dq_riskier_group",
        {"group_col": "{GROUP_COL}", "metric_col": "{RISK_METRIC_COL}", "group_a": "{GROUP_A}",
         "group_b": "{GROUP_B}", "std_multiplier": "{STD_MULTIPLIER}"},
        [features(5), {"type": "min_count_by_kind", "kind": "categorical", "min": 1}],
    )


def _bad_rows(version: int, injector: str) -> dict:
    return _template(
        f"dq_bad_row_indicator_v{version}", QUALITY, "categorical", Q_FILTER,
        [
            target("OUTCOME_COL", ["binary", "categorical", "regression"],
                   ["bool", "int", "float", "string"], unique_count_min=2),
            scalar("BAD_FRACTION", "float", "0.1"), scalar("CORRUPTION_CAP_STD", "float", "2.0"),
        ],
        injector,
        {"outcome_col": "{OUTCOME_COL}", "bad_fraction": "{BAD_FRACTION}",
         "corruption_cap_std": "{CORRUPTION_CAP_STD}"},
        [features(2)],
    )


def _ranking(version: int, question: str, kinds: list[str]) -> dict:
    return _template(
        f"fi_top_features_v{version}", IMPORTANCE, "feature_ranked_list", question,
        [target("OUTCOME_COL", kinds), scalar("K", "int", "5", "1", "10")],
        "fi_top_features", {"target_col": "{OUTCOME_COL}"}, [features(5)], BARE_POOL,
    )


def _curve(
    name: str, category: str, answer_format: str, question: str, strength: str,
    unique: int, least: int,
) -> dict:
    return _template(
        f"{name}_v0", category, answer_format, question,
        [
            target("OUTCOME_COL", ["regression"], NUMBER, unique_count_min=unique),
            scalar("EFFECT_STRENGTH", "float", strength),
        ],
        name, {"outcome_col": "{OUTCOME_COL}", "effect_strength": "{EFFECT_STRENGTH}"},
        [features(least), {"type": "min_count_by_dtype_any_of", "dtypes": NUMBER, "min": 3}],
    )


_HAS_INT = {"type": "min_count_by_dtype", "dtype": "int", "min": 1}


def _trend(version: int, question: str) -> dict:
    return _template(
        f"rca_performance_improve_v{version}", CAUSE, "categorical", question,
        [
            target("OUTCOME_COL", ["binary", "regression"], ["bool", "int", "float"],
                   unique_count_min=2),
            column("TIME_COL", ["categorical", "id_no"], ["int", "date", "datetime", "string"],
                   unique_count_min=2),
            column("GROUP_COL", ["binary", "categorical"], ["bool", "int", "string"],
                   unique_count_min=2, unique_count_max=20),
            value("SPECIFIC_DATE", "TIME_COL", position="middle"),
        ],
        "rca_performance_improve",
        {"outcome_col": "{OUTCOME_COL}", "time_col": "{TIME_COL}", "group_col": "{GROUP_COL}",
         "specific_date": "{SPECIFIC_DATE}"},
        [features(5), _HAS_INT],
    )


def _retrain() -> dict:
    return _template(
        "rca_retrain_point_v0", CAUSE, "row", Q_RETRAIN,
        [
            target("OUTCOME_COL", ["regression"], NUMBER, unique_count_min=2),
            column("ORDER_COL", ["id_no"], NUMBER, unique_count_min=2),
            value("SPECIFIC_ROW_ID", "ORDER_COL", "int"),
        ],
        "rca_retrain_point",
        {"pred_col": "{OUTCOME_COL}", "order_col": "{ORDER_COL}",
         "specific_row_id": "{SPECIFIC_ROW_ID}"},
        [features(5), _HAS_INT],
    )


TEMPLATES = [
    _riskier(0, "5.0"), _riskier(1, "2.0"), _riskier(2, "3.0"),
    _bad_rows(0, "dq_bad_row_indicator"), _bad_rows(1, "dq_bad_row_indicator_v1"),
    _ranking(0, Q_PEARSON, ["regression", "binary", "categorical"]),
    _ranking(1, Q_AUROC, ["binary"]),
    _curve("sf_nonmonotone_peak", SHAPE, "column_value", Q_PEAK, "2.0", 10, 3),
    _curve("sf_monotone_classify", SHAPE, "column_name", Q_MONOTONE, "3.0", 10, 3),
    _curve("ix_interaction_dominant", INTERACTION, "column_pair", Q_PAIR, "1.5", 2, 5),
    _trend(0, Q_TREND), _trend(1, Q_SEGMENTS),
    _retrain(),
]


def templates_frame(spark: SparkSession, templates: list[dict] | None = None) -> DataFrame:
    """Templates as a DataFrame, one row each."""
    from pyspark.sql import functions as F

    texts = [(json.dumps(t),) for t in (TEMPLATES if templates is None else templates)]
    return spark.createDataFrame(texts, "text string").select(
        F.from_json("text", SCHEMA).alias("t")
    ).select("t.*")
