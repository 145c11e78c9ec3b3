"""Phenomenon injectors by name, and how to run several of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabprobe.functions.draws import spec_seed
from tabprobe.operators.inject.base import Injection
from tabprobe.operators.inject.curves import monotone_classify, nonmonotone_peak
from tabprobe.operators.inject.drift import performance_improve, retrain_point
from tabprobe.operators.inject.interaction import interaction_dominant
from tabprobe.operators.inject.quality import (
    bad_row_indicator, bad_row_indicator_v1, riskier_group,
)
from tabprobe.operators.inject.renaming import top_features

INJECTORS: dict[str, Callable[..., Injection]] = {
    "fi_top_features": top_features,
    "dq_riskier_group": riskier_group,
    "dq_bad_row_indicator": bad_row_indicator,
    "dq_bad_row_indicator_v1": bad_row_indicator_v1,
    "rca_performance_improve": performance_improve,
    "rca_retrain_point": retrain_point,
    "sf_nonmonotone_peak": nonmonotone_peak,
    "ix_interaction_dominant": interaction_dominant,
    "sf_monotone_classify": monotone_classify,
}
# These two rename columns and must be told which ones are ids.
RENAMING = ("fi_top_features", "dq_bad_row_indicator_v1")


def inject(
    df: DataFrame, injector: str, params: dict, seed: int, key: str = "row_id",
    ids: list[str] | None = None,
) -> Injection:
    """Run one injector under the seed of its specification.

    A column parameter that names no column (a slot was left open) rejects the injection.
    """
    absent = [v for k, v in params.items() if k.endswith("_col") and v not in df.columns]
    if absent:
        return Injection(injector, df, params).reject(f"no column {absent[0]}")
    own = spec_seed(seed, injector, {k: str(v) for k, v in params.items()})
    if ids and injector in RENAMING:
        params = {**params, "id_no_cols": list(ids)}
    return INJECTORS[injector](df, params, own, key)


def inject_chain(
    df: DataFrame, specs: list[tuple[str, dict]], seed: int, key: str = "row_id"
) -> tuple[DataFrame, list[Injection]]:
    """Apply injectors one after another; unknown names and rejected ones leave the table."""
    done: list[Injection] = []
    for injector, params in specs:
        if injector not in INJECTORS:
            continue
        result = inject(df, injector, params, seed, key)
        done.append(result)
        if result.status == "OK":
            df = result.table
    return df, done


def inject_each(
    df: DataFrame, specs: list[tuple[str, dict]], seed: int, key: str = "row_id",
    ids: list[str] | None = None,
) -> list[Injection]:
    """One independent copy of the table per specification; rejected ones carry the reason."""
    results = []
    for injector, params in specs:
        if injector in INJECTORS:
            results.append(inject(df, injector, params, seed, key, ids))
        else:
            results.append(Injection(injector, df, params).reject("unknown injector"))
    return results
