import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import ranks


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    heavy = np.where(rng.random(6000) < 0.4, 7.0, rng.normal(0, 50, 6000).round(1))
    data = pd.concat(
        [
            pd.DataFrame({"g": "hot", "v": heavy}),
            pd.DataFrame({"g": "cold", "v": rng.normal(5, 1, 777)}),
            pd.DataFrame({"g": "flat", "v": [2.5] * 50}),
            pd.DataFrame({"g": "one", "v": [1.0]}),
        ]
    )
    return data, spark.createDataFrame(data).repartition(5).cache()


SIZINGS = [{}, {"small_group": 0, "rows_per_bucket": 100}, {"small_group": 0}]


@pytest.mark.parametrize("sizing", SIZINGS)
def test_quantiles_equal_numpy(frame, sizing):
    data, df = frame
    probs = [0.0, 0.2, 0.35, 0.5, 0.8, 1.0]
    got = {r["g"]: r["quantiles"] for r in ranks.quantiles(df, ["g"], "v", probs, **sizing).collect()}
    assert set(got) == {"hot", "cold", "flat", "one"}
    for group, part in data.groupby("g"):
        assert np.allclose(got[group], np.quantile(part["v"], probs), atol=1e-12)


@pytest.mark.parametrize("sizing", SIZINGS)
def test_mid_ranks_equal_pandas(frame, sizing):
    data, df = frame
    got = ranks.value_ranks(df, ["g"], "v", [F.sum("v").alias("total")], **sizing).toPandas()
    want = data.assign(r=data.groupby("g")["v"].rank(method="average"))
    want = want.groupby(["g", "v"]).agg(r=("r", "first"), n=("r", "size")).reset_index()
    both = want.merge(got, on=["g", "v"], suffixes=("", "_got"))
    assert len(both) == len(want) == len(got)
    assert (both["r"] == both["mid_rank"]).all() and (both["n"] == both["n_got"]).all()


@pytest.mark.parametrize("sizing", SIZINGS)
def test_order_statistics_on_text(spark, sizing):
    words = [f"w{i % 400:03d}" for i in range(3000)]
    df = spark.createDataFrame([("c", w) for w in words], "g string, v string")
    wanted = spark.createDataFrame([("c", 0), ("c", 1500), ("c", 2999)], "g string, k bigint")
    got = {r["k"]: r["v"] for r in ranks.order_statistics(df, ["g"], "v", wanted, **sizing).collect()}
    ordered = sorted(words)
    assert got == {0: ordered[0], 1500: ordered[1500], 2999: ordered[2999]}


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 3 == 0 else "a", i % 2, float(v)) for i, v in
            enumerate(rng.normal(0, 1, 3000).round(2))]
    rows += [("empty", 0, None), ("empty", 0, None), (None, None, 1.5), ("nan", 1, float("nan"))]
    return spark.createDataFrame(rows, "g string, h int, v double").repartition(4).cache()


def bits(df):
    return sorted((str(r.asDict()) for r in df.collect()))


@pytest.mark.parametrize("sizing", SIZINGS[1:])
def test_null_groups_and_bits_are_the_same_at_any_size(spark, gaps, sizing):
    probs = [0.0, 0.1, 0.37, 0.5, 0.93, 1.0]
    for by in (["g"], ["g", "h"], []):
        small = bits(ranks.quantiles(gaps, by, "v", probs))
        assert bits(ranks.quantiles(gaps, by, "v", probs, **sizing)) == small
        small = bits(ranks.value_ranks(gaps, by, "v", [F.max("h").alias("top")]))
        assert bits(ranks.value_ranks(gaps, by, "v", [F.max("h").alias("top")], **sizing)) == small
    wanted = spark.createDataFrame([(None, 0), (None, 700), ("a", 5)], "g string, k bigint")
    found = bits(ranks.order_statistics(gaps, ["g"], "v", wanted))
    assert len(found) == 3
    assert bits(ranks.order_statistics(gaps, ["g"], "v", wanted, **sizing)) == found


def test_one_group_with_nine_tenths_of_the_rows_and_many_small_ones(spark):
    df = spark.range(60_000).selectExpr(
        "case when id % 10 > 0 then 'hot' else concat('g', id) end as g", "id * 7 % 1000 as v")
    sizing = {"small_group": 0, "rows_per_bucket": 5_000}
    large = ranks.medians(df, ["g"], "v", **sizing)
    assert large.count() == 6_001
    assert bits(large.where("g = 'hot'")) == bits(ranks.medians(df, ["g"], "v").where("g = 'hot'"))


def test_parts_have_the_order_of_the_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([
        rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.float64), 2.0 ** np.arange(-1074, 1024),
        np.nextafter(2.0 ** np.arange(-1070, 1024), 0), [0.0, np.inf, 5e-324, 1.7976931348623157e308]])
    values = values[~np.isnan(values)]
    values = np.concatenate([values, -values, [np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for low, high, parts in ((-np.inf, np.inf, 65536), (0.0, 5e-324, 9), (-1.5e308, 1.7e308, 1000)):
        part = ranks._shares(F.col("v"), F.lit(low), F.lit(high), F.lit(parts).cast("bigint"))
        got = df.where((F.col("v") >= low) & (F.col("v") <= high)).select(
            "v", part.alias("part")).orderBy("v").toPandas()["part"]
        assert got.is_monotonic_increasing and got.min() >= 0 and got.max() <= parts - 1


def test_values_far_from_each_other_and_close_together(spark):
    rng = np.random.default_rng(2)
    close = 1e15 + rng.integers(0, 4000, 5000) / 8.0
    values = np.concatenate([close, [-1e300, 0.0, 3e-310, 1e300], np.full(700, 1e15)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    sizing = {"small_group": 0, "rows_per_bucket": 60}
    probs = [0.0, 0.01, 0.2, 0.5, 0.77, 1.0]
    assert bits(ranks.quantiles(df, [], "v", probs, **sizing)) == bits(
        ranks.quantiles(df, [], "v", probs))
    assert bits(ranks.value_ranks(df, [], "v", **sizing)) == bits(ranks.value_ranks(df, [], "v"))
    bucketed, counts = ranks._bucketed(
        df.withColumn("_group", F.lit(0)), ["_group"], "v", ranks.GroupSizes(len(values), 1), 60)
    assert bucketed.count() == len(values)
    assert counts.agg(F.max("_held")).first()[0] <= 760  # only equal values stay together


def test_all_null_group_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    got = {r["g"]: r["median"] for r in ranks.medians(df, ["g"], "v").collect()}
    assert got == {"a": None, "b": 1.0}
