"""Column algebra, scalar rules and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import (
    LINE_FEATURES, ORDERS, ORDERS_SQL, SEED, as_bigint, lineitem_numbers, orders_study, rounded,
    sql_long, table,
)
from tabprobe.functions import text as X
from tabprobe.functions.numbers import (
    equals_value, is_whole, period_split, to_double, to_numeric, typical_decimals,
)
from tabprobe.operators import columns as C
from tabprobe.operators.moments import half_range, median_bits, xor_bit
from tabprobe.sources.tables import head_rows, size_variants

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


@query("select o_orderkey as row_id, o_custkey, o_totalprice from orders")
def row_ids_found(spark, sf_dir):
    return C.ensure_row_id(table(spark, sf_dir, "orders")).select(
        "row_id", "o_custkey", "o_totalprice"
    )


@query("""
    select count(*) as n, 1::bigint as low, count(*) as high, count(*) as different,
           count(*) * (count(*) + 1) // 2 as total
    from lineitem""")
def row_ids_added(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    held = C.held_values(C.ensure_row_id(rows), F.col("row_id"), rows.count())
    return held.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.count("value").alias("different"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
    )


_DECORATED = """
    select o_orderkey, o_totalprice, case o_orderkey % 7
        when 0 then '$' || o_totalprice::varchar
        when 1 then '(' || o_totalprice::varchar || ')'
        when 2 then ' ' || o_totalprice::varchar || '%'
        when 3 then (o_custkey % 900 + 1)::varchar || ',000'
        when 4 then 'N/A' when 5 then o_orderstatus else '€ ' || o_custkey::varchar end as raw
    from orders"""


@query(f"""
    with cells as ({_DECORATED}), plain as (
        select o_orderkey, raw, trim(replace(replace(replace(replace(
            case when raw like '(%)' then '-' || substr(raw, 2, length(raw) - 2)
                 when regexp_full_match(raw, '\\d{{1,3}}(,\\d{{3}})+') then replace(raw, ',', '')
                 else trim(raw) end, '$', ''), '€', ''), '£', ''), '%', '')) as plain
        from cells)
    select o_orderkey, plain, regexp_full_match(plain, '[+-]?\\d+') as is_int,
           regexp_full_match(plain, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') as is_float,
           try_cast(plain as double) as number,
           lower(trim(raw)) in ('na', 'n/a', 'nan', 'null', 'none', 'nil', 'missing', '?', '-',
                                '--', 'undefined') as is_missing
    from plain""")
def numeric_text(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    raw = (
        F.when(key % 7 == 0, F.concat(F.lit("$"), price))
        .when(key % 7 == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(key % 7 == 2, F.concat(F.lit(" "), price, F.lit("%")))
        .when(key % 7 == 3, F.concat((F.col("o_custkey") % 900 + 1).cast("string"), F.lit(",000")))
        .when(key % 7 == 4, "N/A").when(key % 7 == 5, F.col("o_orderstatus"))
        .otherwise(F.concat(F.lit("€ "), F.col("o_custkey").cast("string")))
    )
    cells = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    plain = X.normalise_numeric(F.col("raw"))
    return to_numeric(cells.select("o_orderkey", "raw", plain.alias("plain")).withColumn(
        "number", F.col("plain")
    ), ["number"]).select(
        "o_orderkey", "plain", X.is_int_text(F.col("plain")).alias("is_int"),
        X.is_float_text(F.col("plain")).alias("is_float"), "number",
        X.is_missing(F.col("raw")).alias("is_missing"),
    )


_LAYOUTS = ["yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm", "dd/MM/yyyy",
            "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMM d, yyyy"]
_STRF = ["%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %H:%M", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%SZ",
         "%b %-d, %Y"]
_TRIED = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M",
          "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M",
          "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"]


@query(f"""
    with cells as (select event_id, case event_id % 6
        {' '.join(f"when {i} then strftime(ts, '{f}')" for i, f in enumerate(_STRF))} end as raw
        from events)
    select event_id, raw,
           strftime(coalesce({', '.join(f"try_strptime(raw, '{f}')" for f in _TRIED)}),
                    '%Y-%m-%d %H:%M:%S') as parsed,
           regexp_matches(raw, '[:TZ]') as has_time
    from cells""")
def parsed_dates(spark, sf_dir):
    raw = F.coalesce(*[
        F.when(F.col("event_id") % 6 == i, F.date_format("ts", layout))
        for i, layout in enumerate(_LAYOUTS)
    ])
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select(
        "event_id", "raw",
        F.date_format(X.parse_datetime(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        X.has_time(F.col("raw")).alias("has_time"),
    )


_TOKENS = ["NA", " n/a ", "NaN", "?", "--", "Undefined", "yes", "T", " off", "0", "maybe", "nil"]


@query(f"""
    with cells as (select event_type,
        [{', '.join(f"'{t}'" for t in _TOKENS)}][(event_id % {len(_TOKENS)})::int + 1] as cell
        from events)
    select event_type, cell, count(*) as n,
           bool_or(lower(trim(cell)) in ('na', 'n/a', 'nan', 'null', 'none', 'nil', 'missing',
               '?', '-', '--', 'undefined')) as is_missing,
           bool_or(lower(trim(cell)) in ('true', 't', 'yes', 'y', 'on', '1', 'false', 'f', 'no',
               'n', 'off', '0')) as is_bool
    from cells group by event_type, cell""")
def missing_and_bool_tokens(spark, sf_dir):
    listed = F.array(*[F.lit(t) for t in _TOKENS])
    cell = F.element_at(listed, (F.col("event_id") % len(_TOKENS)).cast("int") + 1)
    cells = table(spark, sf_dir, "events").select("event_type", cell.alias("cell"))
    return cells.groupBy("event_type", "cell").agg(
        F.count("*").alias("n"), F.bool_or(X.is_missing(F.col("cell"))).alias("is_missing"),
        F.bool_or(X.is_bool_token(F.col("cell"))).alias("is_bool"),
    )


@query("""
    select case when o_orderdate < timestamp '1998-04-01' then 'A' else 'B' end as period,
           o_custkey = 11 as is_eleven, count(*) as n, round(sum(o_totalprice), 2) as total
    from orders group by all""")
def period_counts(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.groupBy(
        period_split(df, "o_orderdate", "1998-04-01").alias("period"),
        equals_value(df, "o_custkey", "11").alias("is_eleven"),
    ).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
# What the keyed draws of this seed have to give; pinned, so that no SQL asks the engine.
_DERANGED = {"p_size": "p_type", "p_type": "p_brand", "p_brand": "p_name", "p_name": "p_size"}
_ANONYMOUS = {
    "p_partkey": "hwrvz", "p_name": "uweve", "p_brand": "usbfr", "p_type": "fhxyg",
    "p_size": "ddigg",
}
_FLAG = "channel_flag"


@query("select {} from part".format(", ".join(f"{c} as {_DERANGED.get(c, c)}" for c in _PART)))
def deranged_columns(spark, sf_dir):
    return C.derange_columns(
        table(spark, sf_dir, "part"), ["p_partkey", "p_retailprice"], SEED
    )[0]


@query("select {} from part".format(", ".join(f"{c} as {_ANONYMOUS.get(c, c)}" for c in _PART)))
def anonymous_columns(spark, sf_dir):
    return C.anonymize_columns(table(spark, sf_dir, "part"), ["p_retailprice"], SEED)[0]


@query(f"select *, (p_size > 25)::int as {_FLAG} from part")
def inserted_column(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    name, position = C.insertion(df.columns, SEED)
    return C.insert_column(df, name, (F.col("p_size") > 25).cast("int"), position)


@query("""
    with m as (select median(l_quantity) as q, median(l_partkey) as p from lineitem),
    bits as (select (l_quantity > q)::bigint as bit_a, (l_partkey > p)::bigint as bit_b,
                    l_extendedprice from lineitem, m)
    select bit_a, bit_b, xor(bit_a, bit_b) as differ, count(*) as n,
           round(avg(l_extendedprice), 4) as mean
    from bits group by all""")
def median_bits_and_xor(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    bits = median_bits(df, ["l_quantity", "l_partkey"])
    a, b = bits["l_quantity"].cast("bigint"), bits["l_partkey"].cast("bigint")
    return df.groupBy(a.alias("bit_a"), b.alias("bit_b"), xor_bit(a, b).alias("differ")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean")
    )


_SCREENED = ["o_orderkey", *ORDERS]


@query(f"""
    with {ORDERS_SQL}, long as ({sql_long('study', _SCREENED, 'o_orderkey')}),
    falls as (select *, x < lag(x) over (partition by feature order by o_orderkey) as falls
              from long)
    select feature, count(distinct x) >= 5 as five, count(distinct x) >= 20 as twenty,
           count(distinct x) = count(*) and not bool_or(coalesce(falls, false)) as id_like
    from falls group by feature""")
def feature_screen(spark, sf_dir):
    df = orders_study(spark, sf_dir)
    five = C.numeric_features(df, "o_totalprice", 5)
    twenty = C.numeric_features(df, "o_totalprice", 20)
    ids = C.id_like(df, _SCREENED, "o_orderkey")
    rows = [(n, n in five, n in twenty, n in ids) for n in _SCREENED]
    return spark.createDataFrame(
        rows, "feature string, five boolean, twenty boolean, id_like boolean"
    )


@query(f"""
    with long as ({sql_long('lineitem', [*LINE_FEATURES, 'l_extendedprice'])})
    select feature, bool_and(abs(x - round(x)) <= 1e-8 + 1e-5 * abs(round(x))) as whole,
           median(greatest(1, length(split_part(x::varchar, '.', 2))))::bigint as places,
           min(x) as min_value, max(x) as max_value, (max(x) - min(x)) / 2 as half_range
    from long group by feature""")
def number_styles(spark, sf_dir):
    df = lineitem_numbers(spark, sf_dir)
    names = df.columns
    long = C.unpivot_numbers(df, names, {})
    styles = long.groupBy("feature").agg(
        F.bool_and(is_whole(F.col("x"))).alias("whole"),
        typical_decimals(F.col("x")).cast("bigint").alias("places"),
    )
    ranges = half_range(df, names).drop("position")
    return styles.join(F.broadcast(ranges), "feature")


@query("select * from orders where o_orderkey between 495 and 505")
def context_rows(spark, sf_dir):
    return C.context_rows(table(spark, sf_dir, "orders"), "o_orderkey", "500")


@query("select o_orderkey, o_totalprice from orders where o_orderkey <= 250")
def head_rows_by_id(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return head_rows(df, 250, "o_orderkey")


@query("""
    select s.size, count(*) as n, round(sum(o_totalprice), 2) as total
    from orders, (values (100::bigint), (500), (1000), (1000000000)) s(size)
    where o_orderkey < s.size and s.size <= (select count(*) from orders)
    group by s.size""")
def size_variant_totals(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return size_variants(df, (100, 500, 1000, 1_000_000_000), "o_orderkey").groupBy("size").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("""
    select l_returnflag, count(try_cast(l_returnflag as double)) as numbers,
           round(sum(l_tax), 4) as tax
    from lineitem group by l_returnflag""")
def coerced_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return rounded(as_bigint(df.groupBy("l_returnflag").agg(
        F.count(to_double(df, "l_returnflag")).alias("numbers"),
        F.sum(to_double(df, "l_tax")).alias("tax"),
    ), "numbers"), tax=4)
