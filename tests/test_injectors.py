import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import moments as M
from tabprobe.operators.answers import answer_safe, indicator_by_data
from tabprobe.operators.columns import (
    NEUTRAL_NAMES, derangement, ensure_row_id, has_inversion, id_like, insertion,
)
from tabprobe.operators.inject import INJECTORS, inject, inject_chain, inject_each
from tabprobe.operators.sampling import sample_exact

N = 400


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(0, 1, N), rng.normal(5, 2, N), rng.integers(0, 40, N)
    data = pd.DataFrame({
        "row_id": np.arange(1, N + 1), "a": a.round(3), "b": b.round(2), "c": c,
        "g": rng.choice(["x", "y", "z"], N), "t": np.arange(N) // 100,
        "y": (10 * a + 6 * b + rng.normal(0, 1, N)).round(2),
    })
    return data, spark.createDataFrame(data).repartition(3).cache()


CASES = {
    "dq_riskier_group": {"group_col": "g", "metric_col": "y", "group_a": "x", "group_b": "z"},
    "dq_bad_row_indicator": {"outcome_col": "y"},
    "dq_bad_row_indicator_v1": {"outcome_col": "y"},
    "fi_top_features": {"target_col": "y"},
    "rca_retrain_point": {"pred_col": "y", "order_col": "row_id", "specific_row_id": "200"},
    "sf_nonmonotone_peak": {"outcome_col": "y"},
    "ix_interaction_dominant": {"outcome_col": "y"},
    "sf_monotone_classify": {"outcome_col": "y"},
}


@pytest.mark.parametrize("injector", sorted(CASES))
def test_same_rows_for_any_partitioning(frame, injector):
    _, df = frame
    one = inject(df, injector, CASES[injector], 3, ids=["row_id"])
    two = inject(df.repartition(9), injector, CASES[injector], 3, ids=["row_id"])
    assert one.status == two.status and set(one.effects) == set(two.effects)
    for name, value in one.effects.items():
        number = isinstance(value, float)
        assert two.effects[name] == (pytest.approx(value, rel=1e-12) if number else value)
    left = one.table.toPandas().sort_values("row_id", ignore_index=True)
    right = two.table.toPandas().sort_values("row_id", ignore_index=True)
    pd.testing.assert_frame_equal(left, right)


def test_riskier_group_changes_two_groups_only(frame):
    data, df = frame
    done = inject(df, "dq_riskier_group", CASES["dq_riskier_group"], 3)
    out = done.table.toPandas().sort_values("row_id", ignore_index=True)
    kept = data["g"] == "y"
    assert (out.loc[kept, "y"] == data.loc[kept, "y"]).all()
    spread = out.groupby("g")["y"].std()
    assert spread[done.effects["risky_group"]] > 3 * spread[done.effects["safe_group"]]
    slots = {"GROUP_COL": "g", "RISK_METRIC_COL": "y", "GROUP_A": "x", "GROUP_B": "z"}
    found = answer_safe("dq_riskier_group_v0", done.table, slots, {done.injector: done.effects})
    assert found.value == done.effects["risky_group"]
    wrong = {done.injector: {**done.effects, "risky_group": done.effects["safe_group"]}}
    assert answer_safe("dq_riskier_group_v0", done.table, slots, wrong).status == "ERROR"


def test_bad_rows_are_an_exact_tenth_and_rise(frame):
    data, df = frame
    done = inject(df, "dq_bad_row_indicator", CASES["dq_bad_row_indicator"], 3)
    flag = done.effects["indicator_col"]
    out = done.table.toPandas().sort_values("row_id", ignore_index=True)
    assert out[flag].sum() == N // 10 == done.effects["n_bad_rows"]
    rise = out["y"] - data["y"]
    assert (rise[out[flag] == 0] == 0).all() and (rise[out[flag] == 1] > 0).all()
    assert rise.max() <= 2 * data["y"].std() + 1e-9
    assert list(out.columns)[-1] == "y"


def test_anonymous_names_keep_outcome_and_ids(frame):
    _, df = frame
    done = inject(df, "dq_bad_row_indicator_v1", CASES["dq_bad_row_indicator_v1"], 3, ids=["t"])
    kept = {"row_id", "y", "t"}
    others = [c for c in done.table.columns if c not in kept]
    assert kept < set(done.table.columns)
    assert all(len(c) == 5 and c.islower() for c in others) and len(set(others)) == len(others)


def test_whole_outcome_stays_whole(spark):
    df = spark.range(1, 101).select(F.col("id").alias("row_id"), (F.col("id") % 17).alias("y"))
    done = inject(df, "dq_bad_row_indicator", {"outcome_col": "y"}, 1)
    assert done.table.where(F.col("y") != F.rint("y")).count() == 0


def test_simpson_paradox_is_planted_and_answered(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        late = i >= 300
        group = "high" if rng.random() < (0.3 if late else 0.7) else "low"
        rows.append((i, int(late) + 2000, group, float((100 if group == "high" else 10) + rng.normal())))
    df = spark.createDataFrame(rows, "row_id bigint, t int, g string, y double")
    params = {"outcome_col": "y", "time_col": "t", "group_col": "g", "specific_date": "2001"}
    done = inject(df, "rca_performance_improve", params, 1)
    assert done.status == "OK"
    assert done.effects["low_groups"] == ["low"] and done.effects["high_groups"] == ["high"]
    out = done.table.toPandas()
    means = out.groupby(["g", "t"])["y"].mean()
    for g in ("low", "high"):
        assert means[g, 2001] - means[g, 2000] == pytest.approx(done.effects["epsilon"])
    whole = out.groupby("t")["y"].mean()
    assert whole[2000] - whole[2001] == pytest.approx(done.effects["composition_gap"] / 2)
    slots = {"OUTCOME_COL": "y", "TIME_COL": "t", "GROUP_COL": "g", "SPECIFIC_DATE": "2001"}
    found = answer_safe("rca_performance_improve_v0", done.table, slots, {done.injector: done.effects})
    assert found.value == "IMPROVED"


def test_retrain_point_moves_only_later_rows(frame):
    data, df = frame
    done = inject(df, "rca_retrain_point", CASES["rca_retrain_point"], 3)
    out = done.table.toPandas().sort_values("row_id", ignore_index=True)
    early = data["row_id"] < 200
    assert (out.loc[early, "y"] == data.loc[early, "y"]).all()
    assert done.effects["n_rows_changed"] == N - 199
    assert out.loc[~early, "y"].mean() == pytest.approx(data.loc[early, "y"].mean(), abs=0.5)


def test_retrain_point_without_features_is_no_change(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "row_id bigint, y double")
    params = {"pred_col": "y", "order_col": "row_id", "specific_row_id": "2"}
    done = inject(df, "rca_retrain_point", params, 1)
    assert done.effects == {"change_row_id": None}
    found = answer_safe("rca_retrain_point_v0", done.table, {}, {done.injector: done.effects})
    assert found.value == "NO"


def test_curves_and_pairs_are_found_again(frame):
    _, df = frame
    checked = 0
    for injector, template in [
        ("sf_nonmonotone_peak", "sf_nonmonotone_peak_v0"),
        ("sf_monotone_classify", "sf_monotone_classify_v0"),
        ("ix_interaction_dominant", "ix_interaction_dominant_v0"),
    ]:
        done = inject(df, injector, CASES[injector], 3)
        if done.status == "OK":
            found = answer_safe(template, done.table, {"OUTCOME_COL": "y"}, {injector: done.effects})
            assert found.status == "OK", found.reason
            checked += 1
        else:
            assert done.reason
    assert checked >= 1


@pytest.mark.parametrize("injector", sorted(INJECTORS))
def test_degenerate_tables_are_rejected_not_failed(spark, injector):
    schema = "row_id bigint, a double, b double, c double, g string, t int, y double"
    params = {**CASES.get(injector, {
        "outcome_col": "y", "time_col": "t", "group_col": "g", "specific_date": "1"})}
    empty = spark.createDataFrame([], schema)
    flat = spark.createDataFrame([(i, 1.0, 1.0, 1.0, "x", 1, 2.0) for i in range(30)], schema)
    for df in (empty, flat):
        done = inject(df, injector, params, 1)
        assert done.status in ("OK", "REJECTED")
        assert done.status == "OK" or done.reason
        done.table.count()


def test_missing_column_rejects(frame):
    _, df = frame
    done = inject(df, "sf_nonmonotone_peak", {"outcome_col": "{OUTCOME_COL}"}, 1)
    assert done.status == "REJECTED"


def test_chain_and_each(frame):
    _, df = frame
    specs = [(n, CASES[n]) for n in ("dq_bad_row_indicator", "dq_riskier_group")]
    table, done = inject_chain(df, [*specs, ("unknown", {})], 5)
    assert [d.injector for d in done] == [n for n, _ in specs]
    assert len(table.columns) == len(df.columns) + 1
    each = inject_each(df, [*specs, ("unknown", {})], 5)
    assert [d.status for d in each] == ["OK", "OK", "REJECTED"]
    assert len(each[1].table.columns) == len(df.columns)


def test_unknown_template_is_skipped(frame):
    assert answer_safe("nothing_v9", frame[1], {}, {}).status == "SKIP"


def test_bad_row_indicator_is_found_in_the_data(frame):
    _, df = frame
    outcome = "y" if "y" in df.columns else df.columns[-1]
    done = inject(df, "dq_bad_row_indicator", {"outcome_col": outcome}, 3)
    if done.status == "OK":
        assert indicator_by_data(done.table, outcome) == done.effects["indicator_col"]
    assert indicator_by_data(df.select(outcome), outcome) is None


def test_inversions_with_ids_far_apart(spark):
    df = spark.range(400).selectExpr("id * 1000003 * 1000003 as row_id", "id as up", "-id as down",
                                     "case when id = 399 then 0 else id end as last")
    assert has_inversion(df.repartition(6), ["up", "down", "last"], "row_id") == {
        "up": False, "down": True, "last": True}


def test_names_run_out():
    taken = [f"{n}_flag" for n in NEUTRAL_NAMES]
    name, _ = insertion(taken, 1)
    assert name not in taken and name.endswith("2_flag")
    name, _ = insertion(NEUTRAL_NAMES, 1)
    assert name.endswith("2_flag")


def test_derangement_has_no_fixed_point():
    for n in range(2, 9):
        names = [f"c{i}" for i in range(n)]
        mapping = derangement(names, n)
        assert sorted(mapping.values()) == names and all(a != b for a, b in mapping.items())


def test_sample_exact_sizes(frame):
    _, df = frame
    for size in (0, 1, 57, N, N + 5):
        picked = {r["row_id"] for r in sample_exact(df, "row_id", size, 9).collect()}
        assert len(picked) == min(size, N)


def test_ensure_row_id_keeps_a_counter(spark):
    df = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "s string, n int")
    assert ensure_row_id(df).columns == ["s", "row_id"]


def test_new_row_ids_for_files_and_other_tables(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i % 9}",) for i in range(500)], "w string").repartition(6)
    words.write.parquet(str(tmp_path / "t"))
    words.write.csv(str(tmp_path / "c"), header=True)
    stored = spark.read.parquet(str(tmp_path / "t"))
    text = spark.read.csv(str(tmp_path / "c"), header=True)
    for df in (stored, text, stored.where("w <> 'w1'"), text.groupBy("w").count()):
        out = ensure_row_id(df).cache()
        ids = sorted(r["row_id"] for r in out.collect())
        assert ids == list(range(1, len(ids) + 1)) and len(ids) == df.count()
        assert out.columns == ["row_id", *df.columns]


def test_id_like_needs_order_and_no_repeats(spark):
    df = spark.range(50).select(
        F.col("id").alias("row_id"), (F.col("id") * 3).alias("up"), (-F.col("id")).alias("down"),
        F.floor(F.col("id") / 2).alias("steps"),
    )
    assert id_like(df, ["row_id", "up", "down", "steps"], "row_id") == {"row_id", "up"}


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (2.0, 5.0, "b")], "y double, k double, s string")
    rows = {r["feature"]: r["r"] for r in M.correlations(df, "y").collect()}
    assert rows == {"k": None, "s": None}


def test_levene_tail_probabilities():
    assert M._t_tail(4.0, 10) == pytest.approx(0.0733880347707, abs=1e-10)
    assert M._t_tail(3.841458820694124, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert M._t_tail(0.0, 5) == 1.0


def test_row_ids_are_counted_in_tasks_of_a_bounded_number_of_rows(spark, sf_dir, monkeypatch):
    from suite.column_queries import row_ids_added
    from tabprobe.operators import columns as C

    monkeypatch.setattr(C, "_ROW_BLOCK", 500)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    found = row_ids_added(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-n // 500)}), REPARTITION_BY_NUM" in plan
    assert tuple(found.first()) == (n, 1, n, n, n * (n + 1) // 2)


def test_a_repeated_number_is_no_row_id(spark):
    df = spark.createDataFrame([(i, i if i != 5 else 4) for i in range(1, 9)], "a long, b long")
    assert ensure_row_id(df.select("b", "a")).columns == ["b", "row_id"]
    assert ensure_row_id(df.select("b")).columns == ["row_id", "b"]
