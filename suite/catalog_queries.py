"""Profiles of the test tables, template matching over them, and stored instances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from suite.base import as_bigint, orders_study, sql_n, sql_pick, sql_u, table
from tabprobe.operators.profiling import column_sample, profile_all, sequential_ids
from tabprobe.plans import matching as M
from tabprobe.plans.build import build_instances, summarise_instances, values_of
from tabprobe.plans.templates import TEMPLATES, templates_frame
from tabprobe.sources.instances import discover_instances, read_manifests, refresh_answers
from tabprobe.sources.shared import cut, fresh_folder

QUERIES, SQL = {}, {}
SEED = 42


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


# Catalog tables: columns as SQL that both engines read alike; the last one is the target.
CATALOG = {
    "orders": ("orders", [
        ("row_id", "o_orderkey + 1"), ("o_custkey", "o_custkey"),
        ("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"),
        ("o_month", "cast(month(o_orderdate) as bigint)"),
        ("o_date", "cast(o_orderdate as date)"), ("o_totalprice", "o_totalprice"),
    ]),
    "customer": ("customer", [
        ("row_id", "c_custkey + 1"), ("c_name", "c_name"), ("c_nationkey", "c_nationkey"),
        ("c_mktsegment", "c_mktsegment"), ("c_debt", "cast(c_acctbal < 0 as int)"),
        ("c_acctbal", "c_acctbal"),
    ]),
    "part": ("part", [
        ("row_id", "p_partkey + 1"), ("p_brand", "p_brand"), ("p_type", "p_type"),
        ("p_size", "p_size"), ("p_retailprice", "p_retailprice"),
    ]),
    "faults": ("events", [
        ("row_id", "event_id + 1"), ("user_id", "user_id"), ("value", "value"), ("props", "props"),
        ("hour", "cast(hour(ts) as bigint)"), ("minute", "cast(minute(ts) as bigint)"),
        ("fault", "cast(event_type = 'error' as int)"),
    ]),
    "supplier": ("supplier", [
        ("row_id", "s_suppkey + 1"), ("s_name", "s_name"), ("s_nationkey", "s_nationkey"),
        ("s_acctbal", "s_acctbal"),
    ]),
}


def catalog_table(spark, sf_dir, name):
    source, columns = CATALOG[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{sql} as {c}" for c, sql in columns])


def catalog(spark, sf_dir):
    return {name: catalog_table(spark, sf_dir, name) for name in CATALOG}


def profiles(spark, sf_dir):
    return profile_all(catalog(spark, sf_dir))


_CELLS = " union all ".join(
    f"select '{name}' as dataset, '{column}' as col, {i} as position, {columns[0][1]} as row_, "
    f"trim(({sql})::varchar) as cell from {source}"
    for name, (source, columns) in CATALOG.items() for i, (column, sql) in enumerate(columns)
)
_MISSING = "('na','n/a','nan','null','none','nil','missing','?','-','--','undefined')"
_BOOLS = "('true','t','yes','y','on','1','false','f','no','n','off','0')"
_DATES = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M"]
PROFILE_SQL = f"""
    cells as ({_CELLS}),
    drawn as (
        select *, row_number() over (partition by dataset, position
                   order by substr(md5('0:cell:' || row_), 1 + position % 24, 8), row_) as place
        from cells where cell <> ''),
    sampled as (select * from drawn where place <= 100),
    formed as (
        select *, lower(cell) not in {_MISSING} as known, lower(cell) in {_BOOLS} as is_bool,
               coalesce({', '.join(f"try_strptime(cell, '{f}')" for f in _DATES)}) is not null
                   as moment,
               regexp_full_match(cell, '[+-]?\\d+') as is_int,
               regexp_full_match(cell, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') as is_float,
               try_cast(cell as double) as number
        from cells where cell <> ''),
    voted as (
        select dataset, col, position, count(*) filter (known) as total,
               count(*) filter (known and is_bool) as bools,
               count(distinct case when known then lower(cell) end) as forms,
               count(*) filter (known and moment) as datetimes,
               count(*) filter (known and not moment and is_int) as ints,
               count(*) filter (known and not moment and not is_int and is_float) as floats,
               count(*) filter (known and not moment and not is_float) as strings,
               count(distinct cell) as unique_count,
               max(case when known and is_int then number end)
                   - min(case when known and is_int then number end) as span,
               count(number) = count(*) as all_finite, count(*) as cells,
               count(distinct number) as numbers,
               coalesce(bool_or(number <> floor(number)), false) as fractional
        from formed group by all),
    typed as (
        select *, case when total = 0 then 'empty'
            when bools = total and forms <= 6 then 'bool'
            when datetimes > 0 and datetimes / total >= 0.9 then 'datetime'
            when ints / total >= 0.9 or floats / total >= 0.9
                then case when floats > 0 then 'float' else 'int' end
            when strings / total >= 0.9 then 'string'
            when (ints + floats) / total >= 0.9 and datetimes + strings = 0
                then case when floats > 0 then 'float' else 'int' end
            else 'mixed' end as dtype
        from voted),
    sequences as (
        select dataset, col, coalesce(count(try_cast(cell as bigint)) = count(*)
                   and min(try_cast(cell as bigint)) = 1
                   and max(try_cast(cell as bigint)) = count(*)
                   and count(distinct try_cast(cell as bigint)) = count(*), false)
                   and count(*) >= least(20, max(held)) as sequential
        from (select *, count(*) over (partition by dataset, position) as held from cells
              where cell <> '')
        group by all),
    targets as (
        select * from (values {', '.join(
            f"('{n}', '{cols[-1][0]}')" for n, (_, cols) in CATALOG.items())}) t(dataset, target)),
    profiles as (
        select dataset, col as column_, position, case
            when sequential then 'id_no' when unique_count = 2 then 'binary'
            when dtype in ('int', 'bool') and span <= 31 and unique_count <= 64 then 'categorical'
            when unique_count > 2 and all_finite and cells >= 2 and (numbers / cells > 0.5
                or (fractional and numbers > 10) or numbers > 20) then 'regression'
            else 'categorical' end as kind, dtype, unique_count, col = target as is_target
        from typed join sequences using (dataset, col) join targets using (dataset))
"""


@query(f"""
    with {PROFILE_SQL}
    select dataset, col as "column", place, row_ as "row", cell from sampled
    where dataset = 'customer'""")
def sampled_cells(spark, sf_dir):
    df = column_sample({"customer": catalog_table(spark, sf_dir, "customer")}, "row_id", 100)
    return as_bigint(df.select("dataset", "column", "place", "row", "cell"), "place")


@query(f"""
    with {PROFILE_SQL} select col as "column", sequential from sequences
    where dataset = 'orders'""")
def sequential_columns(spark, sf_dir):
    tables = {"orders": catalog_table(spark, sf_dir, "orders")}
    return sequential_ids(tables).drop("dataset")


@query(f"""
    with {PROFILE_SQL}
    select dataset, column_ as "column", kind, dtype, unique_count, is_target from profiles""")
def column_profiles(spark, sf_dir):
    return profiles(spark, sf_dir).drop("position")


def _list(items):
    return "[" + ", ".join(f"'{i}'" for i in items) + "]" if items else "null"


def _text(value):
    return "null" if value is None else f"'{value}'"


_SLOTS = ", ".join(
    f"('{t['template_id']}', {i}, '{s['slot']}', '{s['type']}', "
    f"{str(s.get('source') == 'dataset.target').lower()}, {_text(s.get('source_column'))}, "
    f"{_text(s.get('position'))}, {_list(s.get('kind_any_of'))}::varchar[], "
    f"{_list(s.get('dtype_any_of'))}::varchar[], {s.get('unique_count_min', 'null')}, "
    f"{s.get('unique_count_max', 'null')}, {_text(s.get('default') or s.get('min'))})"
    for t in TEMPLATES for i, s in enumerate(t["slots"])
)
_NEEDS = ", ".join(
    f"('{t['template_id']}', {i}, '{r['type']}', {_text(r.get('kind'))}, "
    f"{_list(r.get('dtypes') or ([r['dtype']] if r.get('dtype') else None))}::varchar[], {r['min']}, "
    f"{_list(t['feature_pool']['exclude_dtypes'])}::varchar[])"
    for t in TEMPLATES for i, r in enumerate(t["requirements"])
)
MATCH_SQL = f"""
    {PROFILE_SQL},
    slots as (select * from (values {_SLOTS}) s(template_id, slot_at, slot, type, on_target,
        source_column, pick, kinds, dtypes, low, high, fallback)),
    needs as (select * from (values {_NEEDS}) n(template_id, need_at, need, of_kind, of_types, least_,
        no_types)),
    hits as (
        select dataset, template_id, slot_at, slot, list_sort(list(column_)) as matches
        from profiles join slots on type = 'column'
            and (kinds is null or list_contains(kinds, kind))
            and (dtypes is null or list_contains(dtypes, dtype))
            and (low is null or unique_count >= low) and (high is null or unique_count <= high)
            and (not on_target or is_target)
        group by all),
    every as (
        select targets.dataset, slots.*, hits.matches, src.matches as source_matches
        from targets cross join slots
        left join hits on hits.dataset = targets.dataset and hits.template_id = slots.template_id
            and hits.slot = slots.slot
        left join hits src on src.dataset = targets.dataset and src.template_id = slots.template_id
            and src.slot = slots.source_column),
    held as (
        select dataset, template_id, need_at, any_value(least_) as least_, count(*) filter (case need
            when 'min_feature_count' then not is_target and kind <> 'id_no'
                and not coalesce(list_contains(no_types, dtype), false)
            when 'min_count_by_kind' then kind = of_kind
            else list_contains(of_types, dtype) end) as held
        from profiles cross join needs group by all),
    checked as (
        select dataset, template_id, sum(bad) = 0 as compatible, sum(bad)::bigint as reasons
        from (
            select dataset, template_id, case when type = 'column' then matches is null
                when source_column is not null then source_matches is null else false end::int as bad
            from every
            union all select dataset, template_id, (held < least_)::int from held)
        group by all),
    usable as (select dataset, template_id from checked where compatible),
    own as (
        select every.* from every join usable using (dataset, template_id) where type = 'column'),
    heads as (select dataset, template_id, slot, matches[1] as value from own where on_target),
    ordered as (
        select own.dataset, own.template_id, own.slot, matches, heads.value as head,
               row_number() over (partition by own.dataset, own.template_id order by slot_at) as nth
        from own left join heads using (dataset, template_id) where not on_target),
    first_ as (
        select *, list_filter(matches, lambda m: m is distinct from head)[1] as value
        from ordered where nth = 1),
    second_ as (
        select o.*, list_filter(o.matches, lambda m: m is distinct from o.head
                   and m is distinct from f.value)[1] as value
        from ordered o join first_ f using (dataset, template_id) where o.nth = 2),
    chosen_columns as (
        select dataset, template_id, slot, value from heads
        union all select dataset, template_id, slot, value from first_ where value is not null
        union all select dataset, template_id, slot, value from second_ where value is not null),
    texts as (select distinct dataset, col as column_, cell as value from cells),
    asked as (
        select c.dataset, c.template_id, s.slot, c.value as column_, s.pick, s.slot_at,
               row_number() over (partition by c.dataset, c.template_id, c.value order by s.slot_at)
                   as turn
        from chosen_columns c join slots s on s.template_id = c.template_id
            and s.source_column = c.slot),
    draws as (
        select a.dataset, a.template_id, a.column_, t.value, row_number() over (
            partition by a.dataset, a.template_id, a.column_ order by md5('{SEED}:value:' || a.dataset
            || '|' || a.template_id || '|' || a.column_ || '|' || t.value)) as turn
        from (select distinct dataset, template_id, column_ from asked where pick = 'random') a
        join texts t using (dataset, column_)),
    middles as (
        select dataset, column_, list_sort(list(value)) as l from texts group by all),
    picked as (
        select asked.dataset, asked.template_id, slot, draws.value from asked
            join draws using (dataset, template_id, column_, turn) where pick = 'random'
        union all
        select dataset, template_id, slot, l[len(l) // 2 + 1] from asked
            join middles using (dataset, column_) where pick = 'middle'),
    assigned as (
        select * from chosen_columns union all select * from picked
        union all select dataset, template_id, slot, fallback from slots join usable
            using (template_id) where type <> 'column' and fallback is not null)
"""


def _matches(spark, sf_dir):
    return M.match_all(
        templates_frame(spark), profiles(spark, sf_dir), values_of(catalog(spark, sf_dir)), SEED
    )


@query(f"with {MATCH_SQL} select dataset, template_id, compatible, reasons from checked")
def templates_that_fit(spark, sf_dir):
    checked = M.check_requirements(templates_frame(spark), cut(profiles(spark, sf_dir)))
    return checked.select(
        "dataset", "template_id", "compatible", F.size("reasons").cast("bigint").alias("reasons")
    )


@query(f"""
    with {MATCH_SQL} select dataset, template_id, need_at, held, least_ as need_min from held""")
def requirement_counts(spark, sf_dir):
    counts = M.requirement_counts(templates_frame(spark), cut(profiles(spark, sf_dir)))
    return counts.select("dataset", "template_id", "need_at", "held", "need_min")


@query(f"with {MATCH_SQL} select dataset, template_id, slot, value from assigned")
def slot_values(spark, sf_dir):
    return _matches(spark, sf_dir).select(
        "dataset", "template_id", F.explode("slots").alias("slot", "value")
    )


_SLOT_NAMES = sorted({s["slot"] for t in TEMPLATES for s in t["slots"]})
_RENDERED = reduce(
    lambda text, name: (
        f"replace({text}, '{{{name}}}', coalesce(max(value) filter (slot = '{name}'), '{{{name}}}'))"
    ),
    _SLOT_NAMES, "any_value(question)",
)


@query("with {}, q as (select * from (values {}) q(template_id, question)) "
       "select dataset, template_id, {} as question, any_value(pool) as pool from checked "
       "join q using (template_id) left join assigned using (dataset, template_id) "
       "left join (select dataset, count(*) filter (not is_target and kind <> 'id_no') as pool "
       "from profiles group by dataset) using (dataset) group by dataset, template_id".format(
           MATCH_SQL,
           ", ".join("('{}', '{}')".format(t["template_id"], t["question"].replace("'", "''"))
                     for t in TEMPLATES),
           _RENDERED))
def rendered_questions(spark, sf_dir):
    return _matches(spark, sf_dir).select(
        "dataset", "template_id", "question",
        F.size("feature_pool").cast("bigint").alias("pool"),
    )


def _params_sql(t: dict) -> str:
    parts = []
    for name, text in sorted(t["phenomena"][0]["param_mapping"].items()):
        slot = text.strip("{}")
        parts.append(
            f"'{name}=' || coalesce(max(value) filter (slot = '{slot}'), '{{{slot}}}')"
        )
    return f"when '{t['template_id']}' then " + " || ';' || ".join(parts)


@query("with {}, wanted as (select dataset, template_id, case template_id {} end as injector, "
       "case template_id {} end as params from assigned group by dataset, template_id) "
       "select dataset, injector, params, count(*) as templates, min(template_id) as first "
       "from wanted group by dataset, injector, params".format(
           MATCH_SQL,
           " ".join(f"when '{t['template_id']}' then '{t['phenomena'][0]['injector']}'"
                    for t in TEMPLATES),
           " ".join(_params_sql(t) for t in TEMPLATES)))
def needed_phenomena(spark, sf_dir):
    specs = M.required_phenomena(cut(_matches(spark, sf_dir)))
    listed = F.array_join(F.transform(
        F.array_sort(F.map_entries("params")),
        lambda p: F.concat_ws("=", p["key"], p["value"]),
    ), ";")
    return specs.select(
        "dataset", "injector", listed.alias("params"),
        F.size("templates").cast("bigint").alias("templates"),
        F.array_min("templates").alias("first"),
    )


# Seeds of the injections below (of seed 42, the injector and its parameters) and what
# their keyed draws give; pinned, so that no SQL asks the engine.
_FLAG, _FLAG_RENAMED = "cluster_flag", "lxuku"
_STUDY_NAMES = {"o_custkey": "o_orderstatus", "o_day": "o_month", "o_month": "o_orderpriority"}
_ORDER_NAMES = {"o_custkey": "o_orderstatus", "o_month": "o_orderpriority"}
_SEEDS = {"sf_nonmonotone_peak": 778653157, "ix_interaction_dominant": 377122331}


def _top_sql(rows: str, names: dict[str, str]) -> str:
    """Features by their correlation with the price, under the names they were given."""
    listed = ", ".join(
        f"('{new}', (select abs(corr({old}, o_totalprice)) from {rows}))"
        for old, new in names.items())
    return f"(select string_agg(f, ', ' order by r desc) from (values {listed}) t(f, r))"


def _riskier_sql(rows: str, a: str, b: str, strength: float, seed: int) -> str:
    """The month that varies more once both have new prices around the mean, else null."""
    noise = sql_n("risk", "row_id", seed)
    return f"""(
        with facts as (
            select avg(o_totalprice) as mu, stddev_samp(o_totalprice) as sd,
                   case when {sql_u('coin', "''", seed)} < 0.5 then '{a}' else '{b}' end as risky
            from {rows}),
        risk as (
            select o_month::varchar as grp, risky,
                   mu + ({noise}) * sd * case when o_month::varchar = risky then {strength} else 0.5 end
                       as y
            from {rows}, facts where o_month::varchar in ('{a}', '{b}')),
        spread as (
            select risk.*, abs(y - m) as z
            from risk join (select grp, median(y) as m from risk group by grp) using (grp)),
        sides as (
            select grp, any_value(risky) as risky, count(*) as n, avg(y) as mean, var_samp(y) as v,
                   avg(z) as z, var_pop(z) as vz from spread group by grp),
        test as (
            select (sum(n) - 2) * sum(n * (z - all_z) * (z - all_z)) / sum(n * vz) as f,
                   (max(mean) - min(mean)) / any_value(pooled) as gap,
                   arg_max(grp, v) as answer, any_value(risky) as risky
            from sides, (select avg(z) as all_z, stddev_samp(y) as pooled from spread))
        select case when gap <= 0.5 and f > 4 and answer = risky then answer end from test)"""


_REFRESHED_SQL = f"""
    study as (
        select o_orderkey + 1 as row_id, o_custkey, dayofyear(o_orderdate)::bigint as o_day,
               month(o_orderdate)::bigint as o_month, o_totalprice
        from orders)"""


@query(f"""
    with {_REFRESHED_SQL}
    select 'orders_study' as dataset, regexp_replace(template_id, '_v0$', '') as injector,
           template_id, answer, case when answer is null then 'ERROR' else 'OK' end as status,
           'generated' as summary, true as stored
    from (values
        ('fi_top_features_v0', {_top_sql('study', _STUDY_NAMES)}),
        ('dq_bad_row_indicator_v0', '{_FLAG}'),
        ('dq_riskier_group_v0', {_riskier_sql('study', '9', '3', 5.0, 1593088117)})
    ) t(template_id, answer)""")
def refreshed_answers(spark, sf_dir):
    """Three stored instances, their answers recomputed, and their summaries written."""
    root = fresh_folder(spark, "instances")
    df = orders_study(spark, sf_dir).select(
        (F.col("o_orderkey") + 1).alias("row_id"), "o_custkey", "o_day", "o_month",
        "o_orderstatus", "o_orderpriority", "o_totalprice",
    )
    asked = ["fi_top_features_v0", "dq_bad_row_indicator_v0", "dq_riskier_group_v0"]
    build_instances(spark, df, "orders_study", root, SEED, template_ids=asked)
    answers = refresh_answers(spark, root)
    summaries = summarise_instances(spark, root).withColumnRenamed("status", "summary")
    sizes = discover_instances(spark, root).select("instance", (F.col("bytes") > 0).alias("stored"))
    return answers.join(summaries, "instance", "left").join(sizes, "instance", "left").select(
        "dataset", "injector", "template_id", "answer", "status", "summary", "stored"
    )


_INJECTED = ", ".join(
    f"('{t['template_id']}', '{t['phenomena'][0]['injector']}')" for t in TEMPLATES)
_PLACES = "median(greatest(1, length(split_part({}::varchar, '.', 2))))::int"
_LEVEL = f"0.35 + 0.3 * ({sql_u('peak', chr(39) * 2, _SEEDS['sf_nonmonotone_peak'])})"
_PEAK_ANSWER = f"""(
    with pick as (
        select f from {sql_pick(['o_custkey', 'o_month'], 'feature', _SEEDS['sf_nonmonotone_peak'])} p
        where place = 1),
    xs as (
        select (case f when 'o_custkey' then o_custkey else o_month end)::double as x, f
        from table_, pick),
    ranked as (select x, f, row_number() over (order by x) - 1 as place_, count(*) over () as n from xs),
    spot as (select any_value(f) as f, any_value(n - 1) * ({_LEVEL}) as spot from ranked),
    ends as (
        select any_value(spot.f) as f, any_value(spot) as spot, max(x) filter (place_ = floor(spot)) as lo,
               max(x) filter (place_ = ceil(spot)) as hi
        from ranked, spot)
    select f || ', ' || round_even(
               case when lo = hi then lo
                    else (ceil(spot) - spot) * lo + (spot - floor(spot)) * hi end, 1)::double::varchar
    from ends)"""
_PAIR_NAMES = ["row_id", "o_custkey", "o_month"]
_PAIR_ANSWER = f"""(
    with pick as {sql_pick(_PAIR_NAMES, 'pair', _SEEDS['ix_interaction_dominant'])},
    two as (select min(f) as a, max(f) as b from pick where place <= 2),
    bits as (
        select o_totalprice as y, xor(
            case a {' '.join(f"when '{n}' then ({n} > (select median({n}) from table_))::int" for n in _PAIR_NAMES)} end,
            case b {' '.join(f"when '{n}' then ({n} > (select median({n}) from table_))::int" for n in _PAIR_NAMES)} end)
            as s, a, b
        from table_, two),
    crossed as (
        select a, b, s, y + 1.5 * (select stddev_samp(y) from bits) * (s - (select avg(s) from bits))
               as y from bits)
    select case when avg(y) filter (s = 1) > avg(y) filter (s = 0)
           then any_value(a) || ', ' || any_value(b) end from crossed)"""
_VALLEY_ANSWER = """(
    select case when (count(distinct o_custkey) >= 10)::int + (count(distinct o_month) >= 10)::int < 3
           then null else 'three features' end from table_)"""
_TREND_ANSWER = """(
    with split as (
        select value::date as d from assigned where dataset = 'orders' and slot = 'SPECIFIC_DATE'
            and template_id = 'rca_performance_improve_v0'),
    halves as (
        select o_month, o_totalprice as y, case when o_date < d then 'A' when o_date >= d then 'B' end
               as p from table_, split),
    stats as (
        select o_month, avg(y) filter (p = 'A') as ma, avg(y) filter (p = 'B') as mb
        from halves group by o_month),
    level_ as (
        select p, case when p = 'B' then y + coalesce(ma - mb, 0) else y end as y
        from halves join stats using (o_month))
    select case when avg(y) filter (p = 'A') > avg(y) filter (p = 'B') then 'IMPROVED' end
    from level_)"""
_RETRAIN_ANSWER = """(
    select 'YES, ' || any_value(value) from assigned where dataset = 'orders'
        and slot = 'SPECIFIC_ROW_ID' and template_id = 'rca_retrain_point_v0')"""


@query(f"""
    with {MATCH_SQL},
    table_ as (
        select o_orderkey + 1 as row_id, o_custkey, month(o_orderdate)::bigint as o_month,
               cast(o_orderdate as date) as o_date, o_totalprice
        from orders),
    injectors as (select * from (values {_INJECTED}) i(template_id, injector)),
    answers as (select * from (values
        ('fi_top_features_v0', {_top_sql('table_', _ORDER_NAMES)}),
        ('dq_bad_row_indicator_v0', '{_FLAG}'), ('dq_bad_row_indicator_v1', '{_FLAG_RENAMED}'),
        ('dq_riskier_group_v0', {_riskier_sql('table_', '8', '11', 5.0, 1964003523)}),
        ('dq_riskier_group_v1', {_riskier_sql('table_', '10', '5', 2.0, 2099528395)}),
        ('dq_riskier_group_v2', {_riskier_sql('table_', '1', '2', 3.0, 528785321)}),
        ('sf_nonmonotone_peak_v0', {_PEAK_ANSWER}), ('ix_interaction_dominant_v0', {_PAIR_ANSWER}),
        ('sf_monotone_classify_v0', {_VALLEY_ANSWER}), ('rca_performance_improve_v0', {_TREND_ANSWER}),
        ('rca_performance_improve_v1', {_TREND_ANSWER}), ('rca_retrain_point_v0', {_RETRAIN_ANSWER})
    ) a(template_id, answer))
    select dataset, injector, template_id, case when not compatible then 'NO MATCH'
               when answer is null then 'SKIP' else 'OK' end as status,
           case when compatible then answer end as answer
    from checked join injectors using (template_id) left join answers using (template_id)
    where dataset = 'orders'""")
def built_instances(spark, sf_dir):
    """Status and answer of every template after matching, injecting, answering and storing the
    orders table."""
    root = fresh_folder(spark, "instances")
    report = build_instances(
        spark, catalog_table(spark, sf_dir, "orders"), "orders", root, SEED)
    answers = read_manifests(spark, root).select(
        "injector", F.explode("qa_pairs").alias("qa")).select(
        "injector", "qa.template_id", "qa.answer")
    return report.join(answers, ["injector", "template_id"], "left").select(
        "dataset", "injector", "template_id", "status", "answer")
