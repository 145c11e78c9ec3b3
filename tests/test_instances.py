import json
import shutil
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators.answers import answer_safe
from tabprobe.operators.inject import inject
from tabprobe.plans import build as B
from tabprobe.plans.build import build_instances, read_summary, summarise_instances, summarise_table
from tabprobe.sources import instances as I
from tabprobe.sources import stacked as S


def study(spark):
    rng = np.random.default_rng(4)
    n = 300
    a = rng.normal(0, 1, n)
    return spark.createDataFrame(pd.DataFrame({
        "row_id": np.arange(1, n + 1), "a": a.round(3), "b": rng.normal(3, 1, n).round(3),
        "c": rng.integers(0, 90, n), "g": rng.choice(["u", "v", "w"], n),
        "day": rng.integers(1, 8, n), "y": (5 * a + rng.normal(0, 1, n)).round(2),
    }))


def jobs_of(spark, work):
    """Result of `work` and the number of Spark jobs it took."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "counted")
    try:
        found = work()
        return found, len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context._jsc.clearJobGroup()


def test_build_refresh_discover_summarise(spark, tmp_path):
    root = str(tmp_path / "store")
    asked = ["fi_top_features_v0", "dq_riskier_group_v0", "fi_top_features_v1", "dq_bad_row_indicator_v0"]
    df = study(spark)
    report = {
        r["template_id"]: r["status"]
        for r in build_instances(spark, df, "study_300", root, 7, template_ids=asked).collect()
    }
    assert report == {
        "fi_top_features_v0": "OK", "dq_riskier_group_v0": "OK", "dq_bad_row_indicator_v0": "OK",
        "fi_top_features_v1": "NO MATCH",
    }
    built = {r["instance"]: r["qa_pairs"] for r in I.read_manifests(spark, root).collect()}
    refreshed = I.refresh_answers(spark, root)
    assert {r["status"]: r["n"] for r in I.status_counts(refreshed).collect()} == {"OK": 3}
    assert {r["instance"]: r["qa_pairs"] for r in I.read_manifests(spark, root).collect()} == built
    found = I.discover_instances(spark, root)
    assert found.count() == 3
    assert I.discover_instances(spark, root, injector=["riskier", "nothing"]).count() == 1
    assert I.discover_instances(spark, root, dataset="study").count() == 0
    assert I.discover_instances(spark, root, suffixes=["_300"]).count() == 3
    manifest = I.discover_instances(spark, root, injector="fi_top").first()
    table = I.read_table(spark, root, manifest["instance"])
    assert "row_id" not in table.columns and table.count() == 300
    assert manifest["qa_pairs"][0]["slot_assignments"]["OUTCOME_COL"] == "y"
    first = {r["status"] for r in summarise_instances(spark, root).collect()}
    second = summarise_instances(spark, root)
    assert (first, {r["status"] for r in second.collect()}) == ({"generated"}, {"skipped"})
    assert B.summary_counts(second).first().asDict() == {"generated": 0, "skipped": 3, "failed": 0}
    build_instances(spark, df, "study_300", root, 7, template_ids=["dq_bad_row_indicator_v0"])
    anew = sorted(r["status"] for r in summarise_instances(spark, root).collect())
    assert anew == ["generated", "skipped", "skipped"]


def test_summaries_of_a_set_are_those_of_each_table(spark, tmp_path):
    root = str(tmp_path / "store")
    build_instances(spark, study(spark), "study", root, 7, template_ids=[
        "fi_top_features_v0", "dq_bad_row_indicator_v1"])
    summarise_instances(spark, root)
    for m in I.discover_instances(spark, root).collect():
        one = summarise_table(I.read_table(spark, root, m["instance"]), m["target"])
        for part in B.PARTS:
            whole = read_summary(spark, root, part, m["instance"])
            assert set(whole.columns) == set(one[part].columns), part
            names = sorted(whole.columns)

            def rows(df):
                return sorted(([round(v, 9) if isinstance(v, float) else v for v in r]
                               for r in df.select(*names).collect()), key=str)

            assert rows(whole) == rows(one[part]), part


def test_rejected_instance_is_out_of_use(spark, tmp_path):
    root, df = str(tmp_path / "store"), study(spark)
    done = inject(df, "dq_bad_row_indicator", {"outcome_col": "y"}, 1)
    name = I.write_instance(spark, root, "d", 1, done, [])
    assert I.discover_instances(spark, root).count() == 1
    I.write_instance(spark, root, "d", 1, done.reject("no longer holds"), [])
    assert I.discover_instances(spark, root).count() == 0
    assert [(r["instance"], r["reason"]) for r in I.read_rejects(spark, root).collect()] == [
        (name, "no longer holds")]
    assert not list((tmp_path / "store" / "tables").rglob("*.parquet"))
    with pytest.raises(ValueError):
        I.read_table(spark, root, name)


def test_a_store_where_every_injection_was_rejected(spark, tmp_path):
    root, df = str(tmp_path / "store"), study(spark)
    done = inject(df, "dq_bad_row_indicator", {"outcome_col": "y"}, 1)
    I.write_instance(spark, root, "d", 1, done.reject("never held"), [])
    assert I.discover_instances(spark, root).count() == 0
    assert summarise_instances(spark, root).count() == 0
    assert I.refresh_answers(spark, root).count() == 0
    assert I.read_manifests(spark, str(tmp_path / "nothing")).count() == 0


def test_a_run_that_dies_leaves_the_earlier_instances(spark, tmp_path, monkeypatch):
    root, df = str(tmp_path / "store"), study(spark)
    asked = ["fi_top_features_v0", "dq_bad_row_indicator_v0"]
    build_instances(spark, df, "d", root, 7, template_ids=asked)

    def state():
        found = I.discover_instances(spark, root).collect()
        return {m["instance"]: (m["version"], I.read_table(spark, root, m["instance"]).agg(
            F.sum("y")).first()[0]) for m in found}

    before = state()
    assert len(before) == 2

    def killed(*_):
        raise KeyboardInterrupt

    for step in ("answers_of", "commit_instances"):  # tables lie there, manifests do not
        with monkeypatch.context() as patched:
            patched.setattr(B, step, killed)
            with pytest.raises(KeyboardInterrupt):
                build_instances(spark, df.withColumn("y", F.col("y") * 2), "d", root, 7,
                                template_ids=asked)
        assert state() == before
    build_instances(spark, df.withColumn("y", F.col("y") * 2), "d", root, 7, template_ids=asked)
    after = state()
    assert after.keys() == before.keys()
    assert all(after[k][0] != before[k][0] for k in before)
    versions = [p.name for p in (tmp_path / "store" / "tables").rglob("version=*")]
    assert sorted(versions) == sorted(f"version={v}" for v, _ in after.values())


def test_tables_of_any_types_come_back(spark, tmp_path):
    df = spark.sql("""
        select * from values
          (1L, 2, cast(1.5 as float), 2.5d, true, 'x', date'2020-01-02',
           timestamp'2020-01-02 03:04:05', cast(1.23 as decimal(9,2)), binary('ab'), array(1, null),
           named_struct('a', 1, 'b', cast(null as string)), cast(7 as tinyint)),
          (2L, null, cast('nan' as float), null, null, null, null, null, null, null, null, null, null)
        t(row_id, whole, small, wide, flag, `te xt`, day, at, price, raw, list, nested, tiny)""")
    columns = S.columns_of(df.schema)
    back = S.restored(S.pressed(df), columns)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert str(back.orderBy("row_id").collect()) == str(df.orderBy("row_id").collect())


def many(spark, df, specs, seeds):
    """Injections of some kinds under several seeds, each with the question for it."""
    for seed in seeds:
        for injector, params, template, slots in specs:
            yield seed, inject(df, injector, params, seed), [{
                "template_id": template, "category": "c", "answer_format": "f", "question": "q",
                "slot_assignments": slots, "answer": None}]


SPECS = [
    ("fi_top_features", {"target_col": "y", "outcome_col": "y"}, "fi_top_features_v0",
     {"OUTCOME_COL": "y", "K": "2"}),
    ("dq_riskier_group", {"group_col": "g", "metric_col": "b", "group_a": "u", "group_b": "v"},
     "dq_riskier_group_v0",
     {"GROUP_COL": "g", "RISK_METRIC_COL": "b", "GROUP_A": "u", "GROUP_B": "v"}),
    ("dq_bad_row_indicator", {"outcome_col": "y"}, "dq_bad_row_indicator_v0", {"OUTCOME_COL": "y"}),
    ("dq_bad_row_indicator_v1", {"outcome_col": "y"}, "dq_bad_row_indicator_v1", {"OUTCOME_COL": "y"}),
    ("rca_performance_improve",
     {"outcome_col": "y", "group_col": "g", "time_col": "day", "specific_date": "4"},
     "rca_performance_improve_v0",
     {"OUTCOME_COL": "y", "GROUP_COL": "g", "TIME_COL": "day", "SPECIFIC_DATE": "4"}),
    ("rca_retrain_point", {"pred_col": "y", "order_col": "row_id", "specific_row_id": "100"},
     "rca_retrain_point_v0", {"OUTCOME_COL": "y"}),
    ("sf_nonmonotone_peak", {"outcome_col": "y"}, "sf_nonmonotone_peak_v0", {"OUTCOME_COL": "y"}),
    ("ix_interaction_dominant", {"outcome_col": "y"}, "ix_interaction_dominant_v0",
     {"OUTCOME_COL": "y"}),
    ("sf_monotone_classify", {"outcome_col": "y"}, "sf_monotone_classify_v0", {"OUTCOME_COL": "y"}),
]


def test_answers_of_a_set_are_those_of_each_table(spark, tmp_path):
    root, df = str(tmp_path / "store"), study(spark)
    rows, tables = [], {}
    wrong = [("dq_bad_row_indicator", {"outcome_col": "y"}, t, s) for t, s in (
        ("unknown_v0", {}), ("fi_top_features_v1", {"OUTCOME_COL": "y", "K": "3"}),
        ("dq_riskier_group_v0", {"GROUP_COL": "g"}), ("fi_top_features_v0", {"OUTCOME_COL": "zz"}),
        ("sf_monotone_classify_v0", {"OUTCOME_COL": "y"}), ("rca_retrain_point_v0", {}),
        ("dq_riskier_group_v1", {"GROUP_COL": "g", "RISK_METRIC_COL": "b", "GROUP_A": "u",
                                 "GROUP_B": "v"}),
        ("rca_performance_improve_v1", {"OUTCOME_COL": "y", "GROUP_COL": "g", "TIME_COL": "day",
                                        "SPECIFIC_DATE": "99"}))]
    for seed, done, qa in [*many(spark, df, SPECS, (1, 2)), *(
            (100 + i, *next(many(spark, df, [spec], (3,)))[1:]) for i, spec in enumerate(wrong))]:
        done.status = "OK"  # rejected ones too: their answers must fail alike
        version = I.new_version()
        size = I.store_table(spark, root, "d", seed, done, version)
        row = I.manifest_row("d", seed, done, qa, "d", "y", "row_id", version, size)
        rows.append(row)
        tables[row["instance"]] = (done, qa[0])
    I.commit_instances(spark, root, rows)
    found = {r["instance"]: r for r in I.refresh_answers(spark, root).collect()}
    assert found.keys() == tables.keys()
    for name, (done, qa) in tables.items():
        got = found[name]
        if qa["slot_assignments"].get("OUTCOME_COL") == "zz":
            assert (got["status"], got["reason"]) == ("ERROR", "no column zz")
            continue
        effects = {done.injector: json.loads(json.dumps(done.effects, default=str))}
        one = answer_safe(qa["template_id"], I.read_table(spark, root, name),
                          qa["slot_assignments"], effects)
        assert (got["answer"], got["status"]) == (I.as_text(one.value), one.status), name
        if "missing" not in got["reason"]:
            assert got["reason"] == one.reason, name


def test_jobs_do_not_grow_with_instances(spark, tmp_path):
    df = study(spark).limit(40)
    counts = {}
    for size in (4, 200):
        root = str(tmp_path / f"store{size}")
        done = inject(df, "dq_bad_row_indicator", {"outcome_col": "y"}, 1)
        done.table = done.table.cache()
        rows = []
        qa = [{"template_id": t, "category": "c", "answer_format": "f", "question": "q",
               "slot_assignments": {"OUTCOME_COL": "y", "K": "2"}, "answer": None}
              for t in ("fi_top_features_v0", "dq_bad_row_indicator_v0")]
        version = I.new_version()
        I.store_table(spark, root, "d", 0, done, version)
        first = tmp_path / f"store{size}" / "tables" / "dataset_name=d" / "seed=0"
        for seed in range(size):
            if seed:
                shutil.copytree(first, first.parent / f"seed={seed}")
            rows.append(I.manifest_row("d", seed, done, qa, "d", "y", "row_id", version, 9))
        I.commit_instances(spark, root, rows)
        answers, asked = jobs_of(spark, lambda: I.refresh_answers(spark, root).collect())
        summaries, told = jobs_of(spark, lambda: summarise_instances(spark, root).collect())
        assert len(answers) == 2 * size and {r["status"] for r in answers} == {"OK"}
        assert len(summaries) == size and {r["status"] for r in summaries} == {"generated"}
        counts[size] = (asked, told)
    assert counts[200][0] <= counts[4][0] + 10 and counts[200][1] <= counts[4][1] + 10


def test_every_group_is_stored(spark, tmp_path):
    rng = np.random.default_rng(8)
    n = 8000
    group = rng.integers(0, 1200, n)
    late = rng.random(n) < np.where(group < 600, 0.8, 0.2)
    df = spark.createDataFrame(pd.DataFrame({
        "row_id": np.arange(1, n + 1), "g": [f"g{x}" for x in group],
        "day": np.where(late, 9, 1), "y": np.where(group < 600, 1.0, 50.0) + rng.normal(0, 1, n)}))
    done = inject(df, "rca_performance_improve", {
        "outcome_col": "y", "group_col": "g", "time_col": "day", "specific_date": "5"}, 1)
    assert done.status == "OK", done.reason
    name = I.write_instance(spark, str(tmp_path), "d", 1, done, [])
    assert I.read_groups(spark, str(tmp_path), name).count() == len(set(group))
    assert I.discover_instances(spark, str(tmp_path)).first()["bytes"] > 0


def test_cells_are_read_in_generated_code(spark):
    """Reading cells inside a lambda is interpreted, cell by cell; records are unfolded before."""
    from tabprobe.operators import set_answers

    columns = [("row_id", "bigint", "i", 0), ("x", "double", "f", 0), ("word", "string", "t", 0),
               ("y", "double", "f", 1)]
    rows = spark.createDataFrame(
        [("a", "fi", [i], [float("nan") if i == 3 else i * 0.5, 7.0 - i], [str(i) if i % 2 else "w"])
         for i in range(1, 7)],
        "instance string, injector string, _i array<bigint>, _f array<double>, _t array<string>"
    ).selectExpr("*", "cast(array() as array<date>) as _d", "cast(array() as array<timestamp>) as _s")
    questions = spark.createDataFrame(
        [("q", "a", {"OUTCOME_COL": "y"}, None, columns, "row_id")],
        "question string, instance string, slots map<string,string>,"
        f" effects struct<id_no_cols: array<string>>, columns array<{S.COLUMN}>, row_key string")
    cells = set_answers._scored_features(set_answers._Asked(questions, rows, True))
    assert {(r["name"], r["x"], r["y"]) for r in cells.collect() if r["x"] is not None} == {
        *(("row_id", float(i), 7.0 - i) for i in range(1, 7)),
        *(("x", i * 0.5, 7.0 - i) for i in range(1, 7) if i != 3),
        *(("word", float(i), 7.0 - i) for i in (1, 3, 5))}
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(features" in plan and "explode(transform" not in plan
