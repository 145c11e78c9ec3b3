"""Misleading schema: every feature column carries another one's name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabprobe.operators.columns import derange_columns
from tabprobe.operators.inject.base import Injection


def top_features(df: DataFrame, params: dict, seed: int, key: str = "row_id") -> Injection:
    ids = list(params.get("id_no_cols", []))
    fixed = [params["target_col"], *ids, *params.get("exclude_cols", [])]
    table, mapping = derange_columns(df, fixed, seed)
    return Injection("fi_top_features", table, params, {
        "original_to_new": mapping,
        "new_to_original": {new: old for old, new in mapping.items()},
        "id_no_cols": ids,
    })
