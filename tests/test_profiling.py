from collections import Counter

import pytest

from tabprobe.operators import profiling
from tabprobe.operators.profiling import column_sample, profile, profile_all

ROWS = 60


def cells(i):
    return (
        i + 1, str(i + 1), "yes" if i % 3 else "No", str(i % 7), f"{i * 1.5:.2f}", f"2024-01-{i % 28 + 1:02d}",
        f"w{i}", "n/a" if i % 2 else None, f"${i},000" if i > 9 else "5", "x" if i % 4 else str(i),
        f"{i * 37 % 50}",
    )


COLUMNS = ["row_id", "rank", "agree", "day", "price", "date", "name", "gap", "cost", "mess", "y"]
WANT = {
    "row_id": ("id_no", "int", 60), "rank": ("id_no", "int", 60),
    "agree": ("binary", "bool", 2), "day": ("categorical", "int", 7),
    "price": ("regression", "float", 60), "date": ("categorical", "datetime", 28),
    "name": ("categorical", "string", 60), "gap": ("categorical", "empty", 1),
    "cost": ("categorical", "int", 51), "mess": ("categorical", "mixed", 16),
    "y": ("regression", "int", 50),
}


@pytest.fixture(scope="module")
def small(spark):
    schema = "row_id bigint, " + ", ".join(f"{c} string" for c in COLUMNS[1:])
    return spark.createDataFrame([cells(i) for i in range(ROWS)], schema)


def found(rows):
    return {r["column"]: (r["kind"], r["dtype"], r["unique_count"]) for r in rows}


def test_profile_of_small_table(small):
    rows = profile(small, "small").collect()
    assert found(rows) == WANT
    assert [r["column"] for r in rows if r["is_target"]] == ["y"]


def test_profile_does_not_depend_on_partitions(small):
    assert found(profile(small.repartition(7), "small").collect()) == WANT


def test_several_tables_in_one_plan(small):
    both = profile_all({"a": small, "b": small.select("row_id", "day", "price")}).collect()
    assert Counter(r["dataset"] for r in both) == {"a": 11, "b": 3}
    assert {r["column"] for r in both if r["is_target"]} == {"y", "price"}


def test_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, " ")], "row_id bigint, v string")
    assert found(profile(df, "e").collect())["v"] == ("categorical", "empty", 0)


def test_every_cell_counts(spark):
    rows = [(i, str(i) if i <= 100 else str(2 * i), "x" if i == 777 else str(i), str(i % 30),
             str(1001 - i)) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "row_id bigint, starts string, one string, few string, back string")
    got = found(profile(df, "d").collect())
    assert got["row_id"] == ("id_no", "int", 1000) and got["back"] == ("id_no", "int", 1000)
    assert got["starts"] == ("regression", "int", 1000)
    assert got["one"] == ("categorical", "int", 1000)
    assert got["few"] == ("categorical", "int", 30)


def test_a_catalog_of_many_tables_is_one_plan(small):
    tables = {f"t{i}": small.select("row_id", "day", "price") for i in range(200)}
    rows = profile_all(tables).collect()
    assert len(rows) == 600
    assert {(r["kind"], r["dtype"]) for r in rows if r["column"] == "price"} == {
        ("regression", "float")}


def test_sample_does_not_depend_on_the_prefilter(small, monkeypatch):
    plain = {tuple(r) for r in column_sample({"s": small}, "row_id", 5).collect()}
    monkeypatch.setattr(profiling, "_PREFILTER_ROWS", 10)
    assert {tuple(r) for r in column_sample({"s": small.repartition(4)}, "row_id", 5).collect()} == plain


def test_cells_are_looked_at_without_a_sort_and_shuffled_once(spark, small):
    found_ = profile_all({"a": small, "b": small.select("row_id", "agree")})
    found_.collect()
    plan = found_._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan
    assert "ReusedExchange" in plan


def test_spellings_of_true_and_false_are_counted(spark):
    few, many = ["true", "T", "yes", "y", "no", "N"], ["true", "t", "yes", "y", "no", "n", "off"]
    rows = [(i, few[i % 6], many[i % 7]) for i in range(42)]
    df = spark.createDataFrame(rows, "row_id bigint, few string, many string")
    got = {r["column"]: r["dtype"] for r in profile(df, "d").collect()}
    assert (got["few"], got["many"]) == ("bool", "string")


def test_few_values_are_sorted_for_random_slots(spark):
    import hashlib

    from tabprobe.plans.matching import pick_values

    values = spark.range(20_000).selectExpr("'d' as dataset", "'c' as `column`",
                                            "cast(id % 9000 as string) as value")
    needed = spark.createDataFrame(
        [("d", "t", f"S{i}", "c", "random", i) for i in (1, 2, 3)],
        "dataset string, template_id string, slot string, `column` string, position string, turn int")
    picked = pick_values(needed, lambda pairs: values, 5)
    order = sorted((hashlib.md5(f"5:value:d|t|c|{i}".encode()).hexdigest(), str(i))
                   for i in range(9000))
    assert {(r["slot"], r["value"]) for r in picked.collect()} == {
        (f"S{i + 1}", order[i][1]) for i in range(3)}
    assert "substring(draw" in picked._jdf.queryExecution().analyzed().toString()
    # what the last window reads is a handful of rows, not one per value
    from tabprobe.plans import matching as M
    drawn = spark.createDataFrame([("d", h, v, 3) for h, v in order],
                                  "g string, draw string, value string, most int")
    assert 3 <= M._first_buckets(drawn, ["g"]).count() <= 10
