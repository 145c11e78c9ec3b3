"""Shared pieces of the registered queries and of their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({name: F.round(name, p) for name, p in places.items()})


# SQL text of the keyed draws.
def sql_digest(tag: str, key: str, seed: int = SEED) -> str:
    return f"md5('{seed}:{tag}:' || ({key})::varchar)"


def sql_unit(text: str, start: int) -> str:
    return (
        f"((('0x' || substr({text}, {start}, 8))::bigint)::double + 0.5::double)"
        " / 4294967296::double"
    )


def sql_u(tag: str, key: str, seed: int = SEED) -> str:
    return sql_unit(sql_digest(tag, key, seed), 1)


def sql_n(tag: str, key: str, seed: int = SEED) -> str:
    text = sql_digest(tag, key, seed)
    return (
        f"sqrt(-2::double * ln({sql_unit(text, 1)})) * "
        f"cos(2::double * pi() * ({sql_unit(text, 9)}))"
    )


def sql_pick(names: list[str], tag: str, seed: int = SEED) -> str:
    """Names in keyed random order, numbered from 1: columns ``f, place``."""
    listed = ", ".join(f"('{n}')" for n in names)
    return (
        f"(select f, row_number() over (order by md5('{seed}:{tag}:' || f), f) as place "
        f"from (values {listed}) v(f))"
    )


def sql_long(rows: str, names: list[str], carry: str = "", value: str = "x") -> str:
    """One row per (row, column) as ``feature, x`` next to the carried columns."""
    lead = f"{carry}, " if carry else ""
    return " union all ".join(
        f"select {lead}'{n}' as feature, {n}::double as {value} from {rows} where {n} is not null"
        for n in names
    )


ORDERS = ["o_custkey", "o_day", "o_month"]
ORDERS_SQL = """
    study as (
        select o_orderkey, o_custkey, dayofyear(o_orderdate)::bigint as o_day,
               month(o_orderdate)::bigint as o_month, o_orderstatus, o_orderpriority,
               o_orderdate, o_totalprice
        from orders)
"""


def orders_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with calendar features; the total price is the outcome."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.dayofyear("o_orderdate").cast("bigint").alias("o_day"),
        F.month("o_orderdate").cast("bigint").alias("o_month"),
        "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice",
    )


LINE_FEATURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_discount", "l_tax"]


def lineitem_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_FEATURES, "l_extendedprice")


# Spearman, peak and reversal of bin means in SQL: input ``means(feature, outcome, bin, n, mean)``.
SCORES_SQL = """
    placed as (
        select *, row_number() over (partition by feature, outcome order by bin) as place,
               count(*) over (partition by feature, outcome) as bins,
               rank() over (partition by feature, outcome order by mean)
                 + (count(*) over (partition by feature, outcome, mean) - 1) / 2.0::double as mr,
               sign(mean - lag(mean) over (partition by feature, outcome order by bin)) as turn
        from means),
    turned as (
        select *, lead(turn) over (partition by feature, outcome order by bin) as next_turn
        from placed),
    scores as (
        select feature, outcome, max(bins) as bins,
               case when max(bins) >= 3 then
                 max(case when place > 1 and place < bins then mean end)
                 - min(case when place = 1 or place = bins then mean end) else 0 end as peak_score,
               max(bins) >= 3 and arg_max(place, mean) > 1 and arg_max(place, mean) < max(bins)
                 as peak_inside,
               case when max(bins) >= 3 then round(corr(place, mr), 10) else 1 end as rho,
               max(bins) >= 3 and coalesce(bool_or(turn <> 0 and next_turn <> 0
                 and turn <> next_turn), false) as reversal
        from turned group by feature, outcome)
"""


def sql_bins(rows: str, names: list[str], outcomes: dict[str, str]) -> str:
    """CTEs ``long, edges, binned, means`` for five quantile bins of the named columns."""
    carried = ", ".join(f"{sql} as {name}" for name, sql in outcomes.items())
    means = " union all ".join(
        f"select feature, '{name}' as outcome, bin, count({name}) as n, avg({name}) as mean "
        "from binned group by feature, bin"
        for name in outcomes
    )
    return f"""
    long as ({sql_long(rows, names, carried)}),
    edges as (
        select feature, list_sort(list_distinct(
            quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]))) as e
        from long group by feature),
    binned as (
        select long.*, e, greatest(1, len(list_filter(e, lambda v: v < x))) as bin
        from long join edges using (feature) where len(e) > 1),
    means as ({means})
"""


def as_bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def flag(col: Column) -> Column:
    return col.cast("boolean")
