"""Aggregates, ranks, quantile bins, tests and samples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from suite.base import (
    LINE_FEATURES, SCORES_SQL, SEED, as_bigint, lineitem_numbers, rounded, sql_bins, sql_digest,
    sql_long, table,
)
from tabprobe.functions.numbers import to_double
from tabprobe.operators import moments as M
from tabprobe.operators import shapes as S
from tabprobe.operators.columns import unpivot_numbers
from tabprobe.operators.ranks import quantiles, value_ranks
from tabprobe.operators.sampling import sample_exact

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


_CORR = " union all ".join(
    f"select '{n}' as feature, {i} as position, corr({n}, l_extendedprice) as r from lineitem"
    for i, n in enumerate(LINE_FEATURES)
)


@query(f"""
    select feature, row_number() over (order by abs(r) desc, position) as rank, round(r, 10) as r
    from ({_CORR}) order by abs(r) desc, position limit 5""")
def top_features_pearson(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    best = M.top_k(M.correlations(df, "l_extendedprice"), F.abs(F.col("r")), 5)
    return rounded(as_bigint(best.select("feature", "rank", "r"), "rank"), r=10)


def _auroc_sql(label: str) -> str:
    return f"""
    with base as (select *, {label} as label from lineitem),
    long as ({sql_long('base', LINE_FEATURES, 'label')}),
    ranked as (
        select *, rank() over (partition by feature order by x)
            + (count(*) over (partition by feature, x) - 1) / 2.0::double as mr from long),
    sums as (
        select feature, sum(mr * label) as rank_sum, sum(label)::double as n1,
               sum(1 - label)::double as n0 from ranked group by feature),
    areas as (
        select feature, (rank_sum - n1 * (n1 + 1) / 2) / (n1 * n0) as a from sums)
    select feature, round(greatest(a, 1 - a), 10) as auroc from areas"""


@query(_auroc_sql("(l_extendedprice >= (select median(l_extendedprice) from lineitem))::int"))
def features_by_auroc(spark, sf_dir):
    df = lineitem_numbers(spark, sf_dir)
    return rounded(M.auroc(df, "l_extendedprice").select("feature", "auroc"), auroc=10)


@query(_auroc_sql("(l_returnflag = 'R')::int"))
def features_by_auroc_binary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        *LINE_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )
    scores = M.auroc(df, "returned", small_group=0, rows_per_bucket=5000)
    return rounded(scores.select("feature", "auroc"), auroc=10)


@query("""
    select l_returnflag, l_linestatus, count(*) as n, round(avg(l_extendedprice), 4) as mean,
           round(stddev_samp(l_extendedprice), 4) as std, round(var_samp(l_extendedprice), 1) as var
    from lineitem group by all""")
def moments_by_group(spark, sf_dir):
    df = M.group_moments(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"
    )
    return rounded(df, mean=4, std=4, var=1)


@query("""
    with t as (select o_orderstatus as g, o_totalprice as x from orders
               where o_orderstatus in ('P', 'F'))
    select count(*) filter (g = 'P') as n_a, count(*) filter (g = 'F') as n_b,
           round(avg(x) filter (g = 'P'), 4) as mean_a, round(avg(x) filter (g = 'F'), 4) as mean_b,
           round(stddev_samp(x), 4) as pooled_std,
           round(abs(avg(x) filter (g = 'P') - avg(x) filter (g = 'F')) / stddev_samp(x), 10)
               as mean_gap
    from t""")
def gap_between_groups(spark, sf_dir):
    df = M.group_gap(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "P", "F")
    return rounded(
        df.select("n_a", "n_b", "mean_a", "mean_b", "pooled_std", "mean_gap"),
        mean_a=4, mean_b=4, pooled_std=4, mean_gap=10,
    )


@query("""
    with t as (select l_returnflag as g, l_discount * l_quantity as x from lineitem
               where l_returnflag in ('R', 'N')),
    z as (select g, abs(x - median(x) over (partition by g)) as z from t),
    m as (select g, count(*) as n, avg(z) as zg, var_pop(z) as v from z group by g),
    a as (select avg(z) as za, count(*) as nn from z),
    f as (select max(nn) as nn, max(case g when 'R' then n end) as n_a,
                 max(case g when 'N' then n end) as n_b,
                 (max(nn) - 2) * sum(n * (zg - za) * (zg - za)) / sum(n * v) as f
          from m, a)
    -- 1.959963984540054 is the normal 97.5 % point; the second factor is its first-order
    -- correction to the t distribution with nn - 2 degrees of freedom
    select n_a, n_b, round(f, 8) as f_stat,
           sqrt(f) >= 1.959963984540054 + 2.372271 / (nn - 2) as differs
    from f""")
def variance_test(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn(
        "paid", F.col("l_discount") * F.col("l_quantity")
    )
    return M.levene(df, "l_returnflag", "paid", "R", "N").select(
        "n_a", "n_b", F.round("f_stat", 8).alias("f_stat"), (F.col("p_value") <= 0.05).alias("differs")
    )


_PERIODS = """
    rows as (select o_orderpriority as grp, o_totalprice as y,
                    case when o_orderdate < timestamp '1998-04-01' then 'A' else 'B' end as p
             from orders),
    means as (
        select grp, count(*) filter (p = 'A') as rows_a, count(*) filter (p = 'B') as rows_b,
               avg(y) filter (p = 'A') as mean_a, avg(y) filter (p = 'B') as mean_b
        from rows group by grp)
"""


@query(f"""
    with {_PERIODS} select grp, rows_a, rows_b, round(mean_a, 4) as mean_a,
    round(mean_b, 4) as mean_b from means""")
def means_by_group_and_period(spark, sf_dir):
    df = M.group_period_means(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "1998-04-01",
        "o_totalprice",
    )
    return rounded(df.select("grp", "rows_a", "rows_b", "mean_a", "mean_b"), mean_a=4, mean_b=4)


@query(f"""
    with {_PERIODS}, g as (
        select count(*) as groups, count(*) filter (mean_b > mean_a) as improved,
               count(*) filter (mean_b < mean_a) as worsened
        from means where rows_a > 0 and rows_b > 0),
    o as (select avg(y) filter (p = 'A') as a, avg(y) filter (p = 'B') as b from rows)
    select groups, improved, worsened, round(a, 4) as all_a, round(b, 4) as all_b,
           case when improved = groups then 'IMPROVED' when worsened = groups then 'WORSENED'
                else 'MIXED' end as within,
           case when b > a then 'IMPROVED' when b < a then 'WORSENED' else 'UNCHANGED' end
               as overall
    from g, o""")
def trend_across_split(spark, sf_dir):
    df = M.trend_verdict(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "1998-04-01",
        "o_totalprice",
    )
    return rounded(df.drop("rows_a", "rows_b"), all_a=4, all_b=4)


def _stats_sql(name: str, numbers: list[str], others: list[str]) -> str:
    parts = [
        f"select '{c}' as feature, count(distinct {c}) as n_unique, "
        f"count(*) - count({c}) as n_missing, min({c})::double as min_value, "
        f"max({c})::double as max_value, round(avg({c}), 4) as mean, "
        f"round(stddev_samp({c}), 4) as std from {name}" for c in numbers
    ] + [
        f"select '{c}', count(distinct {c}), count(*) - count({c}), null, null, null, null "
        f"from {name}" for c in others
    ]
    return " union all ".join(parts)


@query(_stats_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def stats_of_part(spark, sf_dir):
    return M.column_stats(table(spark, sf_dir, "part")).drop("position", "dtype")


@query(_stats_sql(
    "lineitem", [*LINE_FEATURES, "l_extendedprice"], ["l_returnflag", "l_linestatus", "l_shipdate"]
))
def stats_of_lineitem(spark, sf_dir):
    return M.column_stats(table(spark, sf_dir, "lineitem")).drop("position", "dtype")


@query("""
    with long as (
        select 'p_brand' as feature, p_brand as value from part union all
        select 'p_type', p_type from part union all select 'p_size', p_size::varchar from part),
    counts as (select feature, value, count(*) as n from long group by all),
    ranked as (select *, row_number() over (partition by feature order by n desc, value) as rank
               from counts)
    select feature, value, n, rank from ranked where rank <= 5""")
def frequent_values(spark, sf_dir):
    df = M.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], 5)
    return as_bigint(df, "rank")


_PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
_QUANTILES_SQL = " union all ".join(
    f"select l_returnflag, {p}::double as prob, round(quantile_cont(l_extendedprice, {p}), 4) as "
    "value from lineitem group by l_returnflag" for p in _PROBS
)


def _quantile_rows(spark, sf_dir, **sizing):
    df = quantiles(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _PROBS, **sizing
    )
    listed = F.arrays_zip(F.array(*[F.lit(p) for p in _PROBS]).alias("prob"), "quantiles")
    return df.select("l_returnflag", F.explode(listed).alias("q")).select(
        "l_returnflag", F.col("q.prob").alias("prob"), F.round("q.quantiles", 4).alias("value")
    )


@query(_QUANTILES_SQL)
def quantiles_by_group(spark, sf_dir):
    return _quantile_rows(spark, sf_dir)


@query(_QUANTILES_SQL)
def quantiles_by_group_bucketed(spark, sf_dir):
    """The same by the way used for groups of any size."""
    return _quantile_rows(spark, sf_dir, small_group=0, rows_per_bucket=500)


_RANKED = ["l_quantity", "l_discount", "l_suppkey"]
_RANKS_SQL = f"""
    with long as ({sql_long('lineitem', _RANKED)}),
    counted as (select feature, x, count(*) as n from long group by all)
    select feature, x, n, coalesce(sum(n) over (partition by feature order by x
               rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2.0::double
               as mid_rank
    from counted"""


@query(_RANKS_SQL)
def average_ranks(spark, sf_dir):
    long = unpivot_numbers(table(spark, sf_dir, "lineitem"), _RANKED, {})
    return value_ranks(long, ["feature"], "x").select("feature", "x", "n", "mid_rank")


@query(_RANKS_SQL)
def average_ranks_bucketed(spark, sf_dir):
    """The same by the way used for groups of any size."""
    long = unpivot_numbers(table(spark, sf_dir, "lineitem"), _RANKED, {})
    return value_ranks(long, ["feature"], "x", small_group=0, rows_per_bucket=2000).select(
        "feature", "x", "n", "mid_rank"
    )


_OUTCOME = {"l_extendedprice": "l_extendedprice"}


@query(f"""
    with {sql_bins('lineitem', LINE_FEATURES, _OUTCOME)}
    select feature, unnest(e) as edge from edges""")
def bin_edges(spark, sf_dir):
    df = lineitem_numbers(spark, sf_dir)
    return S.quantile_edges(df, LINE_FEATURES).select("feature", F.explode("edges").alias("edge"))


@query(f"""
    with {sql_bins('lineitem', LINE_FEATURES, _OUTCOME)}
    select feature, bin::bigint as bin, n, round(mean, 4) as mean from means""")
def means_by_bin(spark, sf_dir):
    df = lineitem_numbers(spark, sf_dir)
    edges = S.quantile_edges(df, LINE_FEATURES)
    means = S.bin_means(
        df, {"l_extendedprice": to_double(df, "l_extendedprice")}, LINE_FEATURES, edges
    )
    return rounded(as_bigint(means.drop("outcome"), "bin"), mean=4)


@query(f"""
    with {sql_bins('lineitem', LINE_FEATURES, _OUTCOME)}, {SCORES_SQL}
    select feature, bins, round(peak_score, 3) as peak_score, peak_inside, round(rho, 8) as rho,
           reversal from scores""")
def shape_of_features(spark, sf_dir):
    df = S.shapes_of(lineitem_numbers(spark, sf_dir), "l_extendedprice", LINE_FEATURES)
    return rounded(df.drop("outcome"), peak_score=3, rho=8)


_PAIRED = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]
_PAIRS = list(combinations(_PAIRED, 2))


@query("with m as (select {}), base as (select l_extendedprice as y, {} from lineitem, m), "
       "pairs as ({}) {}".format(
    ", ".join(f"(select median({n}) from lineitem) as m_{n}" for n in _PAIRED),
    ", ".join(f"({n} > m_{n})::int as b_{n}" for n in _PAIRED),
    " union all ".join(
        f"select '{a}|{b}' as split, xor(b_{a}, b_{b}) as bit, y from base" for a, b in _PAIRS
    ),
    """select split, count(*) filter (bit = 1) as n1, count(*) filter (bit = 0) as n0,
        round(avg(y) filter (bit = 1), 3) as mean1, round(avg(y) filter (bit = 0), 3) as mean0,
        round(abs(avg(y) filter (bit = 1) - avg(y) filter (bit = 0)) / sqrt(
            ((count(*) filter (bit = 1) - 1) * var_samp(y) filter (bit = 1)
             + (count(*) filter (bit = 0) - 1) * var_samp(y) filter (bit = 0))
            / (count(*) - 2)), 8) as d
        from pairs group by split""",
))
def effect_sizes_of_pairs(spark, sf_dir):
    df = lineitem_numbers(spark, sf_dir)
    bits = M.median_bits(df, _PAIRED)
    splits = {f"{a}|{b}": M.xor_bit(bits[a], bits[b]) for a, b in _PAIRS}
    return rounded(
        M.cohens_d(df, "l_extendedprice", splits).drop("position"), mean1=3, mean0=3, d=8
    )


@query(f"""
    select o_orderkey, o_totalprice from orders
    order by {sql_digest('sample', 'o_orderkey')} limit (select count(*) // 10 from orders)""")
def exact_sample(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sample_exact(df, "o_orderkey", df.count() // 10, SEED)
