"""Answers are graded by what they settle on, whatever words stand around it."""

import pytest
from pyspark.sql import functions as F

from tabprobe.operators.grading import rule_grade


@pytest.mark.parametrize("fmt,answer,expected,want", [
    ("binary", "I have no idea", "NO", "INCORRECT"),
    ("binary", "No, it is not needed.", "NO", "CORRECT"),
    ("binary", "The answer is no", "NO", "CORRECT"),
    ("binary", "Yes", "NO", "INCORRECT"),
    ("group", "not F, clearly P", "F", "INCORRECT"),
    ("group", "not F, clearly P", "P", "CORRECT"),
    ("group", "Group **P** is riskier", "P", "CORRECT"),
    ("group", "It is not P", "P", "INCORRECT"),
    ("number", "It is 42.0.", "42", "CORRECT"),
    ("yes_no_row", "retrain: YES, 42", "YES, 42", "CORRECT"),
    ("row", "retrain: YES, 42", "YES, 42", "CORRECT"),
    ("row", "YES, 41", "YES, 42", "PARTIAL"),
    ("column_pair", "a and b", "a, b", "CORRECT"),
    ("column_pair", "b, a", "a, b", "CORRECT"),
    ("column_pair", "a, c", "a, b", "PARTIAL"),
    ("column_value", "price at 3.5", "price, 3.5", "CORRECT"),
    ("column_value", "price, 3.50", "price, 3.5", "CORRECT"),
    ("feature_ranked_list", "[a, b, c]", "a, b, c", "CORRECT"),
    ("feature_ranked_list", "1. a, 2. b and 3. c", "a, b, c", "CORRECT"),
    ("feature_ranked_list", "a, c, b", "a, b, c", "PARTIAL"),
    ("feature_ranked_list", "a, b, c, d", "a, b, c", "PARTIAL"),
    ("feature_ranked_list", "x, y", "a, b, c", "INCORRECT"),
    ("feature_ranked_list", "1. a\n2. b\n3. c", "a, b, c", "CORRECT"),
    ("feature_ranked_list", "1) a\r\n\r\n2) b\r\n3) c.", "a, b, c", "CORRECT"),
    ("feature_ranked_list", "- a\n- b", "a, b", "CORRECT"),
    ("feature_ranked_list", "1. b\n2. a", "a, b", "PARTIAL"),
    ("group", "F and P", "F", "INCORRECT"),
    ("group", "F or P", "F", "INCORRECT"),
    ("group", "P/F", "F", "INCORRECT"),
    ("group", "either F or P is riskier", "P", "INCORRECT"),
    ("group", "P, and I am sure", "P", "CORRECT"),
    ("group", "P is riskier and varies more", "P", "CORRECT"),
    ("categorical", "IMPROVED or WORSENED", "IMPROVED", "INCORRECT"),
    ("categorical", "It improved in some and worsened in others", "IMPROVED", "INCORRECT"),
    ("categorical", "not worsened but improved", "IMPROVED", "CORRECT"),
    ("categorical", "All groups improved.", "IMPROVED", "CORRECT"),
])
def test_grades(spark, fmt, answer, expected, want):
    row = spark.createDataFrame([(fmt, answer, expected)], "f string, a string, e string").select(
        rule_grade(F.col("f"), F.col("a"), F.col("e")).alias("grade")).first()
    assert row["grade"] == want


@pytest.mark.parametrize("answer,want", [
    ("P", "CORRECT"), ("P and F vary", "INCORRECT"), ("P varies more than F", "CORRECT"),
    ("F varies more than P", "INCORRECT"),
    ("not F, P", "CORRECT"), ("P and it is clear", "CORRECT")])
def test_groups_of_the_question_are_options(spark, answer, want):
    row = spark.createDataFrame([(answer,)], "a string").select(rule_grade(
        F.lit("group"), F.col("a"), F.lit("P"), F.lit("Which group, P or F, is riskier?")
    ).alias("grade")).first()
    assert row["grade"] == want
