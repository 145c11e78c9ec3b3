"""Shape functions, importances, interactions and feature summaries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from suite.base import (
    LINE_FEATURES, as_bigint, lineitem_numbers, rounded, sql_bins, table,
)
from tabprobe.operators import summaries as S

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


_NAMED = ["l_returnflag", "l_linestatus"]
_SHAPES = f"""
    {sql_bins('lineitem', LINE_FEATURES, {'y': 'l_extendedprice'})},
    whole as (select avg(l_extendedprice) as mu from lineitem),
    pieces as (
        select feature, 'continuous' as type, bin::bigint as bin, null as label, any_value(e) as e,
               count(*) as n, avg(y) as m, stddev_samp(y) as sd
        from binned group by feature, bin
        {' '.join(
            f"union all select '{c}', 'categorical', null, {c}, null, count(*), "
            f"avg(l_extendedprice), stddev_samp(l_extendedprice) from lineitem group by {c}"
            for c in _NAMED)}),
    shapes as (
        select feature, type, bin, label, e[bin] as lo, e[bin + 1] as hi, n, m - mu as score,
               sd / sqrt(n) as std
        from pieces, whole)
"""


def _shapes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*LINE_FEATURES, *_NAMED, "l_extendedprice")
    return S.shape_function(df, "l_extendedprice")


@query(f"""
    with {_SHAPES} select feature, type, bin, label, lo, hi, n, round(score, 4) as score,
    round(std, 4) as std, round(score - 1.96 * std, 4) as lower, round(score + 1.96 * std, 4) as upper
    from shapes""")
def shape_functions(spark, sf_dir):
    return rounded(as_bigint(_shapes(spark, sf_dir), "bin"), score=4, std=4, lower=4, upper=4)


@query(f"""
    with {_SHAPES} select feature, round(sum(abs(score) * n) / sum(n), 4) as importance
    from shapes group by feature""")
def feature_importances(spark, sf_dir):
    return rounded(S.importance(_shapes(spark, sf_dir)), importance=4)


_CROSSED = ["l_partkey", "l_suppkey", "l_quantity", "l_discount"]
_PAIRS = list(combinations(_CROSSED, 2))
_SURFACE = f"""
    base as (select *, row_number() over () as r from lineitem),
    {sql_bins('base', _CROSSED, {'r': 'r', 'y': 'l_extendedprice'})},
    cells as (
        select a.feature as feat_a, b.feature as feat_b, a.bin as bin_a, b.bin as bin_b,
               count(*) as n, sum(a.y) as total
        from binned a join binned b on a.r = b.r
        where (a.feature, b.feature) in ({', '.join(f"('{a}', '{b}')" for a, b in _PAIRS)})
        group by all),
    surface as (
        select feat_a, feat_b, bin_a, bin_b, n, total / n
            - sum(total) over (partition by feat_a, feat_b, bin_a)
              / sum(n) over (partition by feat_a, feat_b, bin_a)
            - sum(total) over (partition by feat_a, feat_b, bin_b)
              / sum(n) over (partition by feat_a, feat_b, bin_b)
            + sum(total) over (partition by feat_a, feat_b)
              / sum(n) over (partition by feat_a, feat_b) as extra
        from cells),
    ranked as (
        select feat_a, feat_b, sum(abs(extra) * n) / sum(n) as importance,
               row_number() over (order by sum(abs(extra) * n) / sum(n) desc, feat_a, feat_b) as rank
        from surface group by feat_a, feat_b)
"""


@query(f"""
    with {_SURFACE} select feat_a, feat_b, bin_a::bigint as bin_a, bin_b::bigint as bin_b, n,
    round(extra, 3) as extra from surface""")
def interaction_surface(spark, sf_dir):
    df = S.interaction_surface(lineitem_numbers(spark, sf_dir), "l_extendedprice", _PAIRS)
    return rounded(as_bigint(df, "bin_a", "bin_b"), extra=3)


@query(f"with {_SURFACE} select feat_a, feat_b, rank, round(importance, 4) as importance from ranked")
def interaction_ranking(spark, sf_dir):
    df = S.interactions_of(lineitem_numbers(spark, sf_dir), "l_extendedprice", _CROSSED)
    return rounded(as_bigint(df, "rank"), importance=4)


@query(f"""
    with {_SURFACE} select round(max(importance) filter (feat_a = 'l_partkey'
               and feat_b = 'l_quantity'), 4) as importance, count(*) as pairs,
           string_agg(feat_a || ' & ' || feat_b, '; ' order by rank) as available, true as found
    from ranked""")
def interaction_of_pair(spark, sf_dir):
    ranking = S.interactions_of(lineitem_numbers(spark, sf_dir), "l_extendedprice", _CROSSED)
    df = S.find_pair(ranking, "l_quantity", "l_partkey")
    return rounded(df.withColumn("available", F.array_join("available", "; ")), importance=4)


_FS = ["p_partkey", "p_size"]


@query(f"""
    with {sql_bins('part', _FS, {'y': 'p_retailprice'})},
    whole as (select avg(p_retailprice) as mu from part),
    pieces as (
        select feature, count(*) as n, avg(y) as m from binned group by feature, bin
        union all select 'p_brand', count(*), avg(p_retailprice) from part group by p_brand
        union all select 'p_type', count(*), avg(p_retailprice) from part group by p_type),
    weights as (select feature, sum(abs(m - mu) * n) / sum(n) as w from pieces, whole group by 1),
    stats as (
        select 'p_partkey' as feature, 0 as position, count(distinct p_partkey) as u from part
        union all select 'p_brand', 1, count(distinct p_brand) from part
        union all select 'p_type', 2, count(distinct p_type) from part
        union all select 'p_size', 3, count(distinct p_size) from part)
    select feature, row_number() over (order by w desc, position) as rank,
           round(w, 6) as importance, u as n_unique
    from stats join weights using (feature)""")
def ranked_feature_summary(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"
    )
    out = S.feature_summary(df, "p_retailprice")
    return rounded(
        as_bigint(out.select("feature", "rank", "importance", "n_unique"), "rank"), importance=6
    )


@query("""
    select 'o_totalprice' as target, count(*) as n_rows, 5 as n_features,
           'o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority' as features
    from orders""")
def table_overview(spark, sf_dir):
    df = S.overview(table(spark, sf_dir, "orders"), "o_totalprice")
    return df.withColumn("features", F.array_join("features", ", "))


@query("""
    with counts as (select l_returnflag as v, count(*) as n from lineitem group by 1),
    status as (select l_linestatus as v, count(*) as n from lineitem group by 1)
    select 'l_returnflag' as feature, v as value, n from counts
    union all select 'l_linestatus', v, n from status""")
def top_values_of_text(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return S.named_top_values(df, "l_quantity").select(
        "feature", F.explode("top_values").alias("value", "n")
    )
