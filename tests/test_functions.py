import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabprobe.functions import numbers as N
from tabprobe.functions import records as R
from tabprobe.functions import text as X
from tabprobe.operators import grading as G


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def apply(spark, values, fn, kind="string"):
    df = one_column(spark, values, kind)
    rows = df.select("v", fn(F.col("v")).alias("out")).collect()
    return {r["v"]: r["out"] for r in rows}


def test_normalise_numeric(spark):
    want = {
        "(1,234.5)": "-1234.5", " $12 ": "12", "45%": "45", "1,234,567": "1234567",
        "1,23": "1,23", "€3.50": "3.50", "( 7 )": "-7", "abc": "abc", "12 %": "12",
    }
    assert apply(spark, list(want), X.normalise_numeric) == want


def test_parse_datetime(spark):
    want = {
        "2024-1-2": dt.datetime(2024, 1, 2), "2024/01/02 3:04": dt.datetime(2024, 1, 2, 3, 4),
        "1/2/2024": dt.datetime(2024, 1, 2), "31/12/2020": dt.datetime(2020, 12, 31),
        "2024-01-02T03:04:05.120Z": dt.datetime(2024, 1, 2, 3, 4, 5, 120000),
        "2024-13-01": None, "word": None, "12": None, "2024-01-02 03:04:05 and more text": None,
    }
    assert apply(spark, list(want), X.parse_datetime) == want


def test_missing_and_bool_tokens(spark):
    got = apply(spark, ["NA", " n/a ", "--", "", "x"], X.is_missing)
    assert got == {"NA": True, " n/a ": True, "--": True, "": False, "x": False}
    assert apply(spark, ["Yes", "0", "maybe"], X.is_bool_token) == {
        "Yes": True, "0": True, "maybe": False}


def test_decimal_places(spark):
    want = {16.0: 1, 0.07: 2, 1e-5: 5, 123456789.25: 2, 1e25: 1, 2.5: 1, None: None}
    assert apply(spark, list(want), N.decimal_places, "double") == want


def test_round_even(spark):
    assert apply(spark, [0.125, 0.135, 2.5], lambda v: N.round_even(v, 2), "double") == {
        0.125: 0.12, 0.135: 0.14, 2.5: 2.5}


def test_to_double(spark):
    df = spark.createDataFrame(
        [("1.5", float("nan"), True), ("x", 2.0, False), (" 3e2 ", None, None)],
        "s string, d double, b boolean",
    )
    rows = N.to_numeric(df, ["s", "d", "b"]).collect()
    assert [tuple(r) for r in rows] == [(1.5, None, 1.0), (None, 2.0, 0.0), (300.0, None, None)]


def test_period_split_by_type_or_text(spark):
    df = spark.createDataFrame([(9, "9"), (10, "10"), (None, None)], "n int, s string")
    rows = df.select(N.period_split(df, "n", "10"), N.period_split(df, "s", "9")).collect()
    assert [tuple(r) for r in rows] == [("A", "B"), ("B", "A"), (None, None)]


def test_render_and_resolve(spark):
    df = spark.sql("select '{A} of {B} and {C}' as q, map('A', 'x', 'B', 'y') as s, "
                   "map('p', '{A}', 'q', '{C}', 'r', '5') as m")
    row = df.select(
        X.render_question(F.col("q"), F.col("s")), X.resolve_params(F.col("m"), F.col("s"))
    ).first()
    assert row[0] == "x of y and {C}"
    assert row[1] == {"p": "x", "q": "{C}", "r": "5"}


def test_run_label_prefers_the_file_name(spark):
    want = {
        "/d/blind/eval_all_tools_graded.json": "all_tools", "/d/blind/eval_1.json": "blind",
        "/d/eval_python_semantic.json": "semantic", "/d/Eval_RAW.json": "raw",
        "/d/other.part.json": "other.part",
    }
    assert apply(spark, list(want), R.run_label) == want


def test_dataset_size_and_labels(spark):
    assert apply(spark, ["a_100", "a_10000", "a", "a_1b"], R.dataset_size) == {
        "a_100": 100, "a_10000": 10000, "a": 0, "a_1b": 0}
    assert apply(spark, ["claude-x", "gpt-4", "o3", "phi"], R.provider) == {
        "claude-x": "Anthropic", "gpt-4": "OpenAI", "o3": "OpenAI", "phi": "Ollama"}


@pytest.mark.parametrize("fmt,expected,answer,grade", [
    ("categorical", "B", "ERROR: timeout", "INCORRECT"),
    ("categorical", "B", "  ", "INCORRECT"),
    ("categorical", "B", None, "INCORRECT"),
    ("categorical", "B", "b.", "CORRECT"),
    ("categorical", "B", "The riskier group is B", "CORRECT"),
    ("categorical", "B", "Bravo", "INCORRECT"),
    ("column_name", "hum", "the humidity", "INCORRECT"),
    ("feature_ranked_list", '["a", "b", "c"]', "a, b, c", "CORRECT"),
    ("feature_ranked_list", "a, b, c", "b, a, c", "PARTIAL"),
    ("feature_ranked_list", "a, b", "x, y", "INCORRECT"),
    ("column_value", "temp, 0.50", "Temp, 0.5", "CORRECT"),
    ("column_value", "temp, 0.5", "temp, 0.7", "PARTIAL"),
    ("column_pair", "a, b", "b, a", "CORRECT"),
    ("column_pair", "a, b", "b, c", "PARTIAL"),
    ("row", "YES, 42", "yes, 42", "CORRECT"),
    ("row", "YES, 42", "YES, 41", "PARTIAL"),
    ("row", "YES, 42", "NO", "INCORRECT"),
])
def test_grading_rules(spark, fmt, expected, answer, grade):
    df = spark.createDataFrame(
        [(fmt, expected, answer)],
        "answer_format string, expected_answer string, model_answer string",
    )
    assert G.grade(df).first()["grade"] == grade


@pytest.mark.parametrize("dof", [1, 2, 5, 30, 298, 14_998])
@pytest.mark.parametrize("f_stat", [1e-6, 0.3, 1.0, 3.84, 12.5, 40.0])
def test_tail_of_f_is_its_integral(f_stat, dof):
    """P(F(1, dof) > f) to 1e-8, against Simpson's rule over the angle of Student's t."""
    import math

    import numpy as np

    from tabprobe.operators.moments import _t_tail

    angle = np.linspace(math.atan(math.sqrt(f_stat / dof)), math.pi / 2, 400_001)
    density = np.cos(angle) ** (dof - 1)
    weights = np.ones(len(angle))
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    area = (weights * density).sum() * (angle[1] - angle[0]) / 3
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    assert _t_tail(f_stat, dof) == pytest.approx(2 * scale * area, abs=1e-8)
