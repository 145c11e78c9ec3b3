"""Injected tables, their effects, and the answers found in them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite.base import (
    ORDERS, ORDERS_SQL, SCORES_SQL, SEED, orders_study, sql_bins, sql_digest, sql_n, sql_pick,
    sql_u, table,
)
from tabprobe.operators.answers import answer_safe
from tabprobe.operators.inject import INJECTORS, inject_chain
from tabprobe.operators.inject.base import Injection

QUERIES, SQL = {}, {}
KEY = "o_orderkey"


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an outcome that rises with customer key, day and month."""
    df = orders_study(spark, sf_dir)
    score = F.round(F.col("o_totalprice") + F.col("o_custkey") * 400 + F.col("o_day") * 1000, 2)
    return df.select(KEY, *ORDERS, score.alias("o_score"))


SCORED_SQL = f"""{ORDERS_SQL},
    scored as (
        select {KEY}, {', '.join(ORDERS)},
               round(o_totalprice + o_custkey * 400 + o_day * 1000, 2) as o_score
        from study)"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose first period holds more of the dear priorities."""
    df = orders_study(spark, sf_dir)
    early = F.col("o_orderdate") < F.lit("1998-04-01").cast("timestamp_ntz")
    dear = (F.col("o_custkey") % 10 < 7) == early
    price = F.round(F.when(dear, F.col("o_totalprice") + 300000).otherwise(F.col("o_totalprice")), 2)
    return df.select(
        KEY, F.when(dear, "dear").otherwise(F.col("o_orderpriority")).alias("segment"),
        "o_orderdate", price.alias("price"),
    )


MIXED_SQL = """
    flagged as (
        select *, ((o_custkey % 10) < 7) = (o_orderdate < timestamp '1998-04-01') as dear
        from orders),
    mixed as (
        select o_orderkey, case when dear then 'dear' else o_orderpriority end as segment,
               o_orderdate, round(case when dear then o_totalprice + 300000 else o_totalprice end,
               2) as price
        from flagged)"""

PARAMS = {
    "dq_bad_row_indicator": {"outcome_col": "o_totalprice"},
    "dq_riskier_group": {
        "group_col": "o_orderstatus", "metric_col": "o_totalprice", "group_a": "P", "group_b": "F",
        "std_multiplier": "3.0",
    },
    "rca_performance_improve": {
        "outcome_col": "price", "time_col": "o_orderdate", "group_col": "segment",
        "specific_date": "1998-04-01",
    },
    "rca_retrain_point": {
        "pred_col": "value", "order_col": "event_id", "specific_row_id": "600",
    },
    "sf_nonmonotone_peak": {"outcome_col": "o_totalprice"},
    "sf_monotone_classify": {"outcome_col": "o_score"},
    "ix_interaction_dominant": {"outcome_col": "o_totalprice"},
}


def events_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.hour("ts").cast("bigint").alias("hour"),
        F.minute("ts").cast("bigint").alias("minute"), "value",
    )


SOURCES = {
    "dq_bad_row_indicator": (orders_study, KEY),
    "dq_bad_row_indicator_v1": (orders_study, KEY),
    "dq_riskier_group": (orders_study, KEY),
    "rca_performance_improve": (mixed, KEY),
    "rca_retrain_point": (events_study, "event_id"),
    "sf_nonmonotone_peak": (orders_study, KEY),
    "sf_monotone_classify": (scored, KEY),
    "ix_interaction_dominant": (orders_study, KEY),
    "fi_top_features": (scored, KEY),
}
PARAMS["dq_bad_row_indicator_v1"] = {**PARAMS["dq_bad_row_indicator"], "id_no_cols": [KEY]}
PARAMS["fi_top_features"] = {"target_col": "o_score", "id_no_cols": [KEY]}


def injected(spark: SparkSession, sf_dir: str, injector: str) -> Injection:
    source, key = SOURCES[injector]
    return INJECTORS[injector](source(spark, sf_dir), PARAMS[injector], SEED, key)


_STUDY_COLUMNS = [KEY, *ORDERS, "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"]
# What the keyed draws of this seed have to give; pinned, so that no SQL asks the engine.
_FLAG = "channel_flag"
_BAD_SQL = f"""
    with {ORDERS_SQL},
    facts as (select count(*) // 10 as n_bad, stddev_samp(o_totalprice) as sd from study),
    ranked as (
        select *, row_number() over (order by {sql_digest('bad', KEY)}) <= n_bad as bad
        from study, facts)
    select {{columns}}, case when bad then 1 else 0 end as {{flag}},
           round(case when bad then o_totalprice
               + least(abs(({sql_n('noise', KEY)}) * sd * 0.5), sd * 2) else o_totalprice end, 4)
               as o_totalprice
    from ranked"""


@query(_BAD_SQL.format(columns=", ".join([KEY, *ORDERS, "o_orderstatus"]), flag=_FLAG))
def inject_bad_rows(spark, sf_dir):
    df = injected(spark, sf_dir, "dq_bad_row_indicator").table
    return df.select(
        KEY, *ORDERS, "o_orderstatus", _FLAG, F.round("o_totalprice", 4).alias("o_totalprice")
    )


_RENAMED = {
    "o_custkey": "mltpz", "o_day": "pmgvq", "o_month": "ickgi", "o_orderstatus": "jijki",
    "o_orderpriority": "ifxhg", "channel_flag": "ucbbf", "o_orderdate": "yrnlr",
}


@query(_BAD_SQL.format(
    columns=", ".join([KEY, *[f"{c} as {_RENAMED[c]}" for c in [*ORDERS, "o_orderstatus"]]]),
    flag=_RENAMED[_FLAG],
))
def inject_bad_rows_anonymous(spark, sf_dir):
    df = injected(spark, sf_dir, "dq_bad_row_indicator_v1").table
    return df.select(
        KEY, *[_RENAMED[c] for c in [*ORDERS, "o_orderstatus", _FLAG]],
        F.round("o_totalprice", 4).alias("o_totalprice"),
    )


_RISK_SQL = f"""
    {ORDERS_SQL},
    facts as (
        select avg(o_totalprice) as mu, stddev_samp(o_totalprice) as sd,
               case when {sql_u('coin', "''")} < 0.5 then 'P' else 'F' end as risky
        from study),
    risk as (
        select o_orderkey, o_orderstatus, case
            when o_orderstatus = risky then mu + ({sql_n('risk', KEY)}) * sd * 3
            when o_orderstatus in ('P', 'F') then mu + ({sql_n('risk', KEY)}) * sd * 0.5
            else o_totalprice end as o_totalprice
        from study, facts)"""


@query(f"with {_RISK_SQL} select o_orderkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice "
       "from risk")
def inject_riskier_group(spark, sf_dir):
    df = injected(spark, sf_dir, "dq_riskier_group").table
    return df.select(KEY, "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


_SIMPSON_SQL = f"""
    {MIXED_SQL},
    halves as (
        select *, case when o_orderdate < timestamp '1998-04-01' then 'A' else 'B' end as p
        from mixed),
    stats as (
        select segment, count(*) filter (p = 'A') as na, count(*) filter (p = 'B') as nb,
               avg(price) filter (p = 'A') as ma, avg(price) filter (p = 'B') as mb
        from halves group by segment),
    level as (
        select halves.*, case when p = 'B' then price + coalesce(ma - mb, 0) else price end as y
        from halves join stats using (segment)),
    gap as (select avg(y) filter (p = 'A') - avg(y) filter (p = 'B') as gap from level),
    shifted as (
        select o_orderkey, segment, o_orderdate, p,
               case when p = 'B' then y + gap / 2 else y end as price
        from level, gap)"""


@query(f"""
    with {_SIMPSON_SQL}
    select o_orderkey, segment, round(price, 4) as price from shifted""")
def inject_simpson(spark, sf_dir):
    df = injected(spark, sf_dir, "rca_performance_improve").table
    return df.select(KEY, "segment", F.round("price", 4).alias("price"))


@query(f"""
    with {_SIMPSON_SQL},
    means as (select segment as grp, avg(price) as mean from shifted group by segment),
    placed as (select *, row_number() over (order by mean, grp) as place,
                      count(*) over () as groups from means)
    select grp, round(mean, 3) as mean, case when place <= groups // 2 then 'low' else 'high' end
           as side, (select gap > 0 from gap) as injected
    from placed""")
def simpson_groups(spark, sf_dir):
    done = injected(spark, sf_dir, "rca_performance_improve")
    return done.groups.select(
        "grp", F.round("mean", 3).alias("mean"), "side", F.lit(done.status == "OK").alias("injected")
    )


_EVENT_FEATURES = ["user_id", "hour", "minute"]


@query(f"""
    with study as (
        select event_id, user_id, hour(ts)::bigint as hour, minute(ts)::bigint as minute, value
        from events),
    pick as {sql_pick(_EVENT_FEATURES, 'pair')},
    meds as (select {', '.join(f'median({n}) as m_{n}' for n in _EVENT_FEATURES)} from study),
    bits as (
        select study.*, {', '.join(f'({n} > m_{n})::int as b_{n}' for n in _EVENT_FEATURES)}
        from study, meds),
    signal as (
        select bits.*, xor(
            case fa.f {' '.join(f"when '{n}' then b_{n}" for n in _EVENT_FEATURES)} end,
            case fb.f {' '.join(f"when '{n}' then b_{n}" for n in _EVENT_FEATURES)} end) as s
        from bits, (select f from pick where place = 1) fa, (select f from pick where place = 2) fb),
    facts as (
        select avg(value) filter (event_id < 600) as mu,
               stddev_samp(value) filter (event_id < 600) as sd,
               avg(s) filter (event_id >= 600) as level,
               median(greatest(1, length(split_part(value::varchar, '.', 2))))
                   filter (event_id < 600)::int as places
        from signal)
    select event_id, case when event_id >= 600 then round_even(
        mu + (s - level) * (sd * 1.5) + ({sql_n('noise', 'event_id')}) * (sd * 0.2), places)
        else value end as value
    from signal, facts""")
def inject_retrain_point(spark, sf_dir):
    return injected(spark, sf_dir, "rca_retrain_point").table.select("event_id", "value")


_NUMERIC = [KEY, *ORDERS]
_PLACES = "median(greatest(1, length(split_part({}::varchar, '.', 2))))::int"
_PEAK_AT = 0.48024763708235696  # 0.35 and 0.3 times the draw of 42:peak:
_PEAK_SQL = f"""
    {ORDERS_SQL},
    pick as (select f from {sql_pick(_NUMERIC, 'feature')} p where place = 1),
    xs as (
        select study.*, (case f {' '.join(f"when '{n}' then {n}" for n in _NUMERIC)} end)::double
               as x
        from study, pick),
    facts as (
        select round_even(quantile_cont(x, {_PEAK_AT!r}),
                          {_PLACES.format('x')}) as peak,
               (max(x) - min(x)) / 2 as half, stddev_samp(o_totalprice) as sd,
               {_PLACES.format('o_totalprice')} as places
        from xs),
    peaked as (
        select xs.* exclude (o_totalprice), round_even(o_totalprice
               + 2 * sd * (1 - ((x - peak) / half) * ((x - peak) / half)), places) as y
        from xs, facts)"""


@query(f"with {_PEAK_SQL} select o_orderkey, o_custkey, round(y, 2) as o_totalprice from peaked")
def inject_peak(spark, sf_dir):
    df = injected(spark, sf_dir, "sf_nonmonotone_peak").table
    return df.select(KEY, "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"""
    with {_PEAK_SQL}, {sql_bins('peaked', _NUMERIC, {'y': 'y'})}, {SCORES_SQL},
    own as (select scores.* from scores join pick on feature = f)
    select (select f from pick) as feature, (select peak from facts) as peak,
           round((select half from facts), 6) as half_range,
           round(2 * (select sd from facts), 4) as amplitude,
           case when bins >= 3 and peak_inside and peak_score >= 0.5 * (select sd from facts)
                 and not exists (select 1 from scores s where s.feature <> own.feature
                                 and s.peak_score >= own.peak_score)
                then 'OK' else 'REJECTED' end as status
    from own""")
def peak_effects(spark, sf_dir):
    done = injected(spark, sf_dir, "sf_nonmonotone_peak")
    e = done.effects
    return spark.createDataFrame(
        [(e["peak_feature"], float(e["peak_value"]), round(e["half_range"], 6),
          round(e["amplitude"], 4), done.status)],
        "feature string, peak double, half_range double, amplitude double, status string",
    )


_TRIALS = {n: f"y_{n}" for n in ORDERS}
_VALLEY_FACTS = ", ".join(
    f"round_even(median({n}), {_PLACES.format(n + '::double')}) as mid_{n}, "
    f"(max({n}) - min({n})) / 2.0::double as half_{n}" for n in ORDERS
)
_VALLEY_SQL = f"""
    {SCORED_SQL},
    facts as (
        select stddev_samp(o_score) as sd, {_PLACES.format('o_score')} as places, {_VALLEY_FACTS}
        from scored),
    trials as (
        select scored.*, {', '.join(
            f"round_even(o_score - 3 * sd * (1 - abs(({n} - mid_{n}) / half_{n})), places) as y_{n}"
            for n in ORDERS)}
        from scored, facts),
    {sql_bins('trials', ORDERS, {'o_score': 'o_score', **{f'y_{n}': f'y_{n}' for n in ORDERS}})},
    {SCORES_SQL},
    pick as {sql_pick(ORDERS, 'candidate')},
    usable as (
        select own.feature, pick.place
        from scores own join pick on own.feature = pick.f and own.outcome = 'y_' || pick.f
        where abs(own.rho) < 0.5 and own.reversal
          and (select abs(rho) from scores b where b.feature = own.feature
               and b.outcome = 'o_score') >= 0.6
          and not exists (select 1 from scores r where r.outcome = own.outcome
                          and r.feature <> own.feature and abs(r.rho) <= abs(own.rho))),
    chosen as (select arg_min(feature, place) as f from usable)"""


@query(f"""
    with {_VALLEY_SQL}
    select o_orderkey, round(case (select f from chosen)
        {' '.join(f"when '{n}' then y_{n}" for n in ORDERS)} else o_score end, 2) as o_score
    from trials""")
def inject_valley(spark, sf_dir):
    df = injected(spark, sf_dir, "sf_monotone_classify").table
    return df.select(KEY, F.round("o_score", 2).alias("o_score"))


@query(f"""
    with {_VALLEY_SQL}
    select f as feature, case f {' '.join(f"when '{n}' then mid_{n}" for n in ORDERS)} end::double
               as midpoint,
           round(3 * sd, 4) as amplitude,
           case f {' '.join(f"when '{n}' then half_{n}" for n in ORDERS)} end as half_range
    from chosen, facts where f is not null""")
def valley_effects(spark, sf_dir):
    done = injected(spark, sf_dir, "sf_monotone_classify")
    e = done.effects
    rows = [(e["injected_feature"], float(e["midpoint"]), round(e["amplitude"], 4),
             e["half_range"])] if done.status == "OK" else []
    return spark.createDataFrame(
        rows, "feature string, midpoint double, amplitude double, half_range double"
    )


_OTHERS = [p for p in combinations(_NUMERIC, 2)]
_XOR_SQL = f"""
    {ORDERS_SQL},
    pick as {sql_pick(_NUMERIC, 'pair')},
    fa as (select f from pick where place = 1), fb as (select f from pick where place = 2),
    meds as (select {', '.join(f'median({n}) as m_{n}' for n in _NUMERIC)},
                    stddev_samp(o_totalprice) as sd, {_PLACES.format('o_totalprice')} as places
             from study),
    bits as (
        select study.*, sd, places, {', '.join(f'({n} > m_{n})::int as b_{n}' for n in _NUMERIC)}
        from study, meds),
    signal as (
        select bits.*, xor(
            case (select f from fa) {' '.join(f"when '{n}' then b_{n}" for n in _NUMERIC)} end,
            case (select f from fb) {' '.join(f"when '{n}' then b_{n}" for n in _NUMERIC)} end) as s
        from bits),
    crossed as (
        select signal.* exclude (o_totalprice), round_even(o_totalprice
               + 1.5 * sd * (s - (select avg(s) from signal)), places) as y
        from signal)"""


@query(f"with {_XOR_SQL} select o_orderkey, s, round(y, 2) as o_totalprice from crossed")
def inject_interaction(spark, sf_dir):
    from tabprobe.operators.moments import median_bits, xor_bit

    done = injected(spark, sf_dir, "ix_interaction_dominant")
    pair = [done.effects["feat_a"], done.effects["feat_b"]]
    bits = median_bits(done.table, pair)
    return done.table.select(
        KEY, xor_bit(bits[pair[0]], bits[pair[1]]).alias("s"),
        F.round("o_totalprice", 2).alias("o_totalprice"),
    )


_D_SQL = """(abs(avg(y) filter (b = 1) - avg(y) filter (b = 0)) / sqrt(
    ((count(*) filter (b = 1) - 1) * var_samp(y) filter (b = 1)
     + (count(*) filter (b = 0) - 1) * var_samp(y) filter (b = 0)) / (count(*) - 2)))"""


@query(f"""
    with {_XOR_SQL},
    pairs as ({' union all '.join(
        f"select '{a}' as a, '{c}' as c, xor(b_{a}, b_{c}) as b, y from crossed"
        for a, c in _OTHERS)}),
    sizes as (select a, c, {_D_SQL} as d from pairs group by a, c),
    chosen as (select least((select f from fa), (select f from fb)) as x,
                      greatest((select f from fa), (select f from fb)) as z),
    own as (select d from sizes, chosen where least(a, c) = x and greatest(a, c) = z),
    rivals as (select max(d) as d from sizes, chosen
               where not (least(a, c) = x and greatest(a, c) = z)),
    mains as (select greatest({', '.join(
        f"case when '{n}' in (x, z) then (select abs(corr({n}, y)) from crossed) else 0 end"
        for n in _NUMERIC)}) as r from chosen)
    select x || ', ' || z as pair, round(1.5 * (select max(sd) from crossed), 4) as amplitude,
           case when own.d >= 0.5 and mains.r <= 0.7 and coalesce(rivals.d, 0) < own.d then 'OK'
                else 'REJECTED' end as status
    from chosen, own, rivals, mains""")
def interaction_effects(spark, sf_dir):
    done = injected(spark, sf_dir, "ix_interaction_dominant")
    pair = ", ".join(sorted([done.effects["feat_a"], done.effects["feat_b"]]))
    return spark.createDataFrame(
        [(pair, round(done.effects["amplitude"], 4), done.status)],
        "pair string, amplitude double, status string",
    )


_SWAPPED = {"o_custkey": "o_day", "o_day": "o_month", "o_month": "o_custkey"}


@query(f"""
    with {SCORED_SQL} select o_orderkey, o_score,
    {', '.join(f'{old} as {new}' for old, new in _SWAPPED.items())} from scored""")
def inject_swapped_names(spark, sf_dir):
    return injected(spark, sf_dir, "fi_top_features").table


ASKED = {
    "fi_top_features": ("fi_top_features_v0", {"OUTCOME_COL": "o_score", "K": "3"}),
    "dq_riskier_group": ("dq_riskier_group_v2", {
        "GROUP_COL": "o_orderstatus", "RISK_METRIC_COL": "o_totalprice",
        "GROUP_A": "P", "GROUP_B": "F"}),
    "dq_bad_row_indicator": ("dq_bad_row_indicator_v0", {"OUTCOME_COL": "o_totalprice"}),
    "dq_bad_row_indicator_v1": ("dq_bad_row_indicator_v1", {"OUTCOME_COL": "o_totalprice"}),
    "rca_performance_improve": ("rca_performance_improve_v0", {
        "OUTCOME_COL": "price", "TIME_COL": "o_orderdate", "GROUP_COL": "segment",
        "SPECIFIC_DATE": "1998-04-01"}),
    "rca_retrain_point": ("rca_retrain_point_v0", {"OUTCOME_COL": "value"}),
    "sf_nonmonotone_peak": ("sf_nonmonotone_peak_v0", {"OUTCOME_COL": "o_totalprice"}),
    "sf_monotone_classify": ("sf_monotone_classify_v0", {"OUTCOME_COL": "o_score"}),
    "ix_interaction_dominant": ("ix_interaction_dominant_v0", {"OUTCOME_COL": "o_totalprice"}),
}


_UPPER = f"""(
        select case when var_samp(o_totalprice) filter (o_orderstatus = 'P')
            > var_samp(o_totalprice) filter (o_orderstatus = 'F') then 'P' else 'F' end from risk)"""
_TREND = """(
        with m as (
            select avg(price) filter (p = 'B') > avg(price) filter (p = 'A') as up
            from shifted group by segment having count(distinct p) = 2)
        select case when bool_and(up) and (select avg(price) filter (p = 'B')
            < avg(price) filter (p = 'A') from shifted) then 'IMPROVED' end from m)"""
_TOP = ", ".join(
    f"('{_SWAPPED[n]}', (select abs(corr({n}, o_score)) from scored))" for n in ORDERS
)


def _answer_sql(injector: str, select: str, ctes: str = "") -> str:
    with_ = f"with {ctes} " if ctes else ""
    return f"select '{injector}' as injector, ({with_}{select}) as answer"


@query(" union all ".join([
    _answer_sql("dq_bad_row_indicator", f"select '{_FLAG}'"),
    _answer_sql("dq_bad_row_indicator_v1", f"select '{_RENAMED[_FLAG]}'"),
    _answer_sql("dq_riskier_group", f"select {_UPPER}", _RISK_SQL),
    _answer_sql("rca_performance_improve", f"select {_TREND}", _SIMPSON_SQL),
    _answer_sql("rca_retrain_point", "select 'YES, 600'"),
    _answer_sql("sf_nonmonotone_peak",
                "select (select f from pick) || ', ' || peak::double::varchar from facts", _PEAK_SQL),
    _answer_sql("sf_monotone_classify", "select f from chosen", _VALLEY_SQL),
    _answer_sql("ix_interaction_dominant", "select least(a.f, b.f) || ', ' || greatest(a.f, b.f) "
                "from fa a, fb b", _XOR_SQL),
    _answer_sql("fi_top_features", "select string_agg(f, ', ' order by r desc) "
                f"from (values {_TOP}) t(f, r)", SCORED_SQL),
]))
def answers_after_injection(spark, sf_dir):
    """Every injector, and the answer its question gets from the injected table."""
    def ask(injector: str) -> tuple:
        template_id, slots = ASKED[injector]
        done = injected(spark, sf_dir, injector)
        found = answer_safe(
            template_id, done.table, slots, {injector: done.effects}, SOURCES[injector][1]
        )
        value = ", ".join(found.value) if isinstance(found.value, list) else found.value
        return injector, value if done.status == "OK" else None

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(ask, ASKED))
    return spark.createDataFrame(rows, "injector string, answer string")


_CHAIN = [
    ("dq_bad_row_indicator", PARAMS["dq_bad_row_indicator"]),
    ("unknown", {}),
    ("dq_riskier_group", PARAMS["dq_riskier_group"]),
    ("fi_top_features", {"target_col": "o_totalprice"}),
]
_FIRST, _SECOND = 1959219177, 1203299374  # seeds of the first and the third link


@query(f"""
    with {ORDERS_SQL},
    facts as (select count(*) // 10 as n_bad, stddev_samp(o_totalprice) as sd from study),
    ranked as (
        select *, row_number() over (order by {sql_digest('bad', KEY, _FIRST)}) <= n_bad as bad
        from study, facts),
    raised as (
        select o_orderkey, o_orderstatus, case when bad then o_totalprice
            + least(abs(({sql_n('noise', KEY, _FIRST)}) * sd * 0.5), sd * 2)
            else o_totalprice end as y
        from ranked),
    spread as (
        select avg(y) as mu, stddev_samp(y) as sd,
               case when {sql_u('coin', "''", _SECOND)} < 0.5 then 'P' else 'F' end as risky
        from raised),
    risk as (
        select o_orderkey, case when o_orderstatus = risky
                then mu + ({sql_n('risk', KEY, _SECOND)}) * sd * 3
            when o_orderstatus in ('P', 'F') then mu + ({sql_n('risk', KEY, _SECOND)}) * sd * 0.5
            else y end as y
        from raised, spread)
    select o_orderkey % 100 as part, count(*) as n, round(sum(y), 3) as total,
           '{','.join(name for name, _ in _CHAIN if name in INJECTORS)}' as steps
    from risk group by 1""")
def chained_injections(spark, sf_dir):
    """Three injections on one table, in order; the unknown one is passed over."""
    df, done = inject_chain(orders_study(spark, sf_dir), _CHAIN, SEED, KEY)
    # The last step gave the order key another column's name.
    key = done[-1].effects["original_to_new"][KEY]
    steps = F.lit(",".join(d.injector for d in done))
    return df.groupBy((F.col(key) % 100).alias("part")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 3).alias("total"),
    ).withColumn("steps", steps)
