"""Reports over evaluation records derived from the events, and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import as_bigint, rounded, sql_u, table
from tabprobe.functions import records as R
from tabprobe.functions.draws import draw_u
from tabprobe.operators import grading as G
from tabprobe.operators import reports as P
from tabprobe.plans.templates import TEMPLATES
from tabprobe.sources.tables import union_records

QUERIES, SQL = {}, {}

MODELS = ["claude-a", "claude-b", "gpt-4o", "o3-mini", "llama", "qwen"]
RUNS = ["blind", "csv_context", "semantic_only", "python_only", "all_tools"]
TEMPLATE_IDS = [t["template_id"] for t in TEMPLATES]
SIZES = ["100", "500", "1000", "10000", "full"]
# Fixed values, pinned here so that no SQL asks the engine for its rules.
_RUN_RULES = [
    ("blind", "blind"), ("all_tools", "all_tools"), ("csv_context", "csv_context"),
    ("semantic_only", "semantic_only"), ("python_semantic", "semantic"),
    ("python_only", "python_only"), ("semantic", "semantic"), ("tools", "tools"), ("raw", "raw"),
]
_ACCURACY_SETS = [
    ["model"], ["model", "run"], ["model", "template_id"], ["model", "template_id", "run"],
    ["template_id", "run"], ["model", "dataset_size"], ["model", "category"],
]
COMPONENTS = ["overview", "feature_importances", "shape_function", "shape_function", "zoom"]


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def _from_list(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def results(spark, sf_dir):
    """One evaluation record per event; every field is a rule of the event's own values."""
    e, u = F.col("event_id"), F.col("user_id")
    chance = draw_u(5, "grade", "event_id")

    def call(i):
        given = F.to_json(F.struct(
            _from_list(COMPONENTS, (e + i) % 5).alias("component"),
            F.concat_ws("_", "event_type", (u % 7).cast("string")).alias("feature"),
        ))
        return F.struct(
            F.when((e + i) % 9 != 0, "context").alias("tool"),
            F.when((e + i) % 7 == 0, "print(1)").otherwise(given).alias("input"),
        )

    calls = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), call), lambda c, i: i < e % 4)
    seconds = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        _from_list(MODELS, u % 6).alias("model"), _from_list(RUNS, e % 5).alias("run"),
        _from_list(TEMPLATE_IDS, u % 13).alias("template_id"),
        F.concat_ws("_", "event_type", _from_list(SIZES, u % 5)).alias("dataset"),
        F.when(seconds < 0.5, "").when(seconds < 1, "  ").when(chance > 0.98, F.lit(None))
        .otherwise(F.concat(F.lit("answer "), "event_type")).alias("model_answer"),
        F.when(chance < 0.5, "CORRECT").when(chance < 0.65, "PARTIAL")
        .when(chance < 0.95, "INCORRECT").alias("grade"),
        F.struct(
            F.when(e % 11 != 0, F.floor(seconds * 100)).cast("bigint").alias("input_tokens"),
            F.when(e % 13 != 0, u * 3 + e % 50).cast("bigint").alias("output_tokens"),
            F.when(e % 17 != 0, F.sqrt(seconds)).alias("ttft_s"),
            F.sqrt(seconds + u).alias("total_latency_s"),
        ).alias("metrics"),
        calls.alias("tool_use"),
    )


def categories(spark):
    return spark.createDataFrame(
        [(t["template_id"], t["category"]) for t in TEMPLATES if "rca" not in t["template_id"]],
        "template_id string, category string",
    )


def derived(spark, sf_dir):
    return P.derive(results(spark, sf_dir), F.broadcast(categories(spark)))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_CHANCE = sql_u("grade", "event_id", 5)
_CATEGORY = " ".join(
    f"when '{t['template_id']}' then '{t['category']}'" for t in TEMPLATES
    if "rca" not in t["template_id"]
)
D = f"""
    raw as (
        select *, {_list(MODELS)}[user_id % 6 + 1] as model, {_list(RUNS)}[event_id % 5 + 1] as run,
               {_list(TEMPLATE_IDS)}[user_id % 13 + 1] as template_id,
               event_type || '_' || {_list(SIZES)}[user_id % 5 + 1] as dataset,
               case when value < 0.5 then '' when value < 1 then '  ' when {_CHANCE} > 0.98 then null
                    else 'answer ' || event_type end as model_answer,
               case when {_CHANCE} < 0.5 then 'CORRECT' when {_CHANCE} < 0.65 then 'PARTIAL'
                    when {_CHANCE} < 0.95 then 'INCORRECT' end as grade,
               case when event_id % 11 <> 0 then floor(value * 100)::bigint end as input_tokens,
               case when event_id % 13 <> 0 then user_id * 3 + event_id % 50 end as output_tokens,
               case when event_id % 17 <> 0 then sqrt(value) end as ttft_s,
               sqrt(value + user_id) as total_latency_s, event_id % 4 as n_calls
        from events),
    d as (
        select *, coalesce(try_cast(regexp_extract(dataset, '_(\\d+)$', 1) as bigint), 0)
                   as dataset_size,
               coalesce(case template_id {_CATEGORY} end, 'other') as category,
               case when model like 'claude%' then 'Anthropic'
                    when regexp_matches(model, '^(gpt-|o1|o3|o4)') then 'OpenAI'
                    else 'Ollama' end as provider,
               coalesce(trim(model_answer), '') = '' as is_empty,
               coalesce(trim(model_answer), '') = '' or grade is null as is_error,
               coalesce(input_tokens, 0) + coalesce(output_tokens, 0) as total_tokens
        from raw)
"""
CALLS = f"""{D},
    c as (
        select d.*, i, case when (event_id + i) % 9 <> 0 then 'context' else '?' end as tool,
               case when (event_id + i) % 7 = 0 then '?'
                    else {_list(COMPONENTS)}[(event_id + i) % 5 + 1] end as component,
               case when (event_id + i) % 7 = 0 then null
                    else event_type || '_' || (user_id % 7)::varchar end as feature
        from d, (values (0), (1), (2), (3)) v(i) where i < n_calls)
"""
_RIGHT = "coalesce(grade = 'CORRECT', false)::int"


@query(f"""
    with {D} select event_id, provider, category, dataset_size, total_tokens, is_empty, is_error,
    n_calls::bigint as n_calls, replace(replace(template_id, '_v0', ''), '_v1', ' v1') as label
    from d""")
def derived_records(spark, sf_dir):
    return as_bigint(derived(spark, sf_dir).select(
        "event_id", "provider", "category", "dataset_size", "total_tokens", "is_empty", "is_error",
        "n_calls", R.template_label(F.col("template_id")).alias("label"),
    ), "n_calls", "dataset_size")


@query(f"""
    with paths as (
        select event_id, '/data/eval/' || {_list(RUNS)}[event_id % 5 + 1] || '/eval_'
               || ['results', 'python_semantic', 'raw_one', 'tools'][event_id % 4 + 1]
               || '.graded.json' as path from events),
    stems as (select *, lower(regexp_replace(split_part(path, '/', 5), '\\.[^.]*$', '')) as stem
              from paths),
    rules as (select * from (values {', '.join(
        f"({i}, '{s}', '{label}')" for i, (s, label) in enumerate(_RUN_RULES))}) r(at_, part, label)),
    hits as (
        select event_id, stem, arg_min(label, at_) filter (contains(stem, part)) as by_stem,
               arg_min(label, at_) filter (contains(lower(path), part)) as by_path
        from stems, rules group by event_id, stem)
    select coalesce(by_stem, by_path, stem) as run, count(*) as n from hits group by 1""")
def runs_from_paths(spark, sf_dir):
    path = F.concat(
        F.lit("/data/eval/"), _from_list(RUNS, F.col("event_id") % 5), F.lit("/eval_"),
        _from_list(["results", "python_semantic", "raw_one", "tools"], F.col("event_id") % 4),
        F.lit(".graded.json"),
    )
    return table(spark, sf_dir, "events").groupBy(R.run_label(path).alias("run")).agg(
        F.count("*").alias("n")
    )


def _sets_sql(sets: list[list[str]], body: str, where: str) -> str:
    names = sorted({n for s in sets for n in s}, key=lambda n: [n in s for s in sets], reverse=True)
    parts = []
    for s in sets:
        label = ",".join(n for n in names if n in s)
        cols = ", ".join(n if n in s else f"null as {n}" for n in names)
        group = f"group by {', '.join(s)}" if s else ""
        parts.append(f"select {cols}, '{label}' as grouping, {body} from d {where} {group}")
    return f"with {D} " + " union all ".join(parts)


_ACC = f"round(avg({_RIGHT}), 8) as accuracy, count(*) as n"


@query(_sets_sql(_ACCURACY_SETS, _ACC, "where not is_empty"))
def accuracy_cube(spark, sf_dir):
    return rounded(P.accuracy_cube(derived(spark, sf_dir)), accuracy=8)


@query(_sets_sql([["model"], ["model", "run"]], _ACC, "where not is_empty and dataset_size < 10000"))
def accuracy_on_small_tables(spark, sf_dir):
    small = derived(spark, sf_dir).where(F.col("dataset_size") < 10000)
    return rounded(P.accuracy_cube(small, sets=[["model"], ["model", "run"]]), accuracy=8)


@query(_sets_sql(_ACCURACY_SETS, _ACC, ""))
def accuracy_with_empty(spark, sf_dir):
    return rounded(P.accuracy_cube(derived(spark, sf_dir), drop_empty=False), accuracy=8)


def _grades_sql(grades, where=""):
    return f"with {D} select model, " + ", ".join(
        f"count(*) filter (coalesce(grade, 'EMPTY') = '{g}') as {g}" for g in grades
    ) + f" from d {where} group by model"


@query(_grades_sql(R.GRADES, "where not is_empty"))
def grades_by_model(spark, sf_dir):
    return P.grade_pivot(derived(spark, sf_dir))


@query(_grades_sql([*R.GRADES, "EMPTY"]))
def grades_by_model_with_empty(spark, sf_dir):
    return P.grade_pivot(derived(spark, sf_dir), with_empty=True)


@query(_sets_sql(
    [[], ["model"], ["run"], ["model", "run"], ["dataset"]], "count(*) filter (is_empty) as empty, count(*) as total, "
    "round(avg(is_empty::int), 8) as rate", "",
))
def empty_answer_rates(spark, sf_dir):
    return rounded(P.empty_rates(derived(spark, sf_dir)), rate=8)


def _medians_sql(by: str, where: str) -> str:
    return f"with {D} " + " union all ".join(
        f"select {by}, '{m}' as metric, count({m}) as n, round(median({m}::double), 2) as median "
        f"from d where {m} is not null {where} group by {by}" for m in P.METRICS
    )


@query(_medians_sql("model, run", "and not is_error"))
def metric_medians(spark, sf_dir):
    return P.metric_medians(derived(spark, sf_dir), ["model", "run"])


@query(_medians_sql("provider", ""))
def metric_medians_with_errors(spark, sf_dir):
    return P.metric_medians(
        derived(spark, sf_dir), ["provider"], drop_errors=False, small_group=0, rows_per_bucket=500
    )


@query(f"""
    with {D} select template_id, run, round(median(input_tokens), 2) as input_median,
           round(median(coalesce(output_tokens, 0)), 2) as output_median,
           round(median(input_tokens), 2) + round(median(coalesce(output_tokens, 0)), 2) as tokens
    from d where not is_error group by all having median(input_tokens) is not null""")
def token_medians(spark, sf_dir):
    return P.token_medians(derived(spark, sf_dir))


@query(f"""
    with {D} select count(*) as records, count(distinct model) as models, count(distinct run) as runs,
    count(distinct template_id) as templates, count(*) filter (is_empty) as empty,
    count(*) filter (not is_empty) as kept from d""")
def record_overview(spark, sf_dir):
    return P.overview(derived(spark, sf_dir))


@query(f"with {D} select model, " + ", ".join(
    f"count(*) filter (template_id = '{t}') as {t}" for t in TEMPLATE_IDS
) + " from d group by model")
def records_by_model_and_template(spark, sf_dir):
    return P.model_template_counts(results(spark, sf_dir), TEMPLATE_IDS)


@query(f"with {D} select model, " + ", ".join(
    f"count(*) filter (grade = '{g}') as {g.lower()}" for g in R.GRADES
) + ", count(*) as n from d group by model")
def grade_summary(spark, sf_dir):
    return P.grade_summary(results(spark, sf_dir))


_SEMANTIC = "run in ('semantic_only', 'semantic')"


def _semantic(spark, sf_dir):
    return derived(spark, sf_dir).where(F.col("run").isin("semantic_only", "semantic"))


_CALL_STATS = """count(*) as n, sum(n_calls)::bigint as calls, avg(n_calls) as mean,
    max(n_calls)::bigint as most, count(*) filter (n_calls = 0) as zero_calls,
    median(n_calls) as median"""


@query(f"with {D} select model, {_CALL_STATS} from d where {_SEMANTIC} group by model")
def calls_by_model(spark, sf_dir):
    return as_bigint(P.call_stats(_semantic(spark, sf_dir), ["model"]), "most")


@query(f"with {D} select model, grade, {_CALL_STATS} from d where grade is not null group by all")
def calls_by_grade(spark, sf_dir):
    kept = derived(spark, sf_dir).where(F.col("grade").isNotNull())
    return as_bigint(P.call_stats(kept, ["model", "grade"]), "most")


@query(f"with {D} select {_CALL_STATS} from d where {_SEMANTIC}")
def calls_overall(spark, sf_dir):
    return as_bigint(P.call_stats(_semantic(spark, sf_dir), []), "most")


@query(f"with {D} select model, n_calls::bigint as n_calls, count(*) as n from d group by all")
def call_histogram(spark, sf_dir):
    return as_bigint(P.call_histogram(derived(spark, sf_dir)), "n_calls")


@query(f"""
    with {CALLS} select null as model, component, 'component' as grouping, count(*) as n
    from c group by component union all
    select model, component, 'component,model', count(*) from c group by model, component""")
def calls_by_component(spark, sf_dir):
    return P.component_counts(P.tool_calls(derived(spark, sf_dir)))


@query(f"with {CALLS} select model, " + ", ".join(
    f"count(*) filter (component = '{c}') as {c}" for c in ["overview", "feature_importances", "shape_function"]
) + " from c group by model")
def components_by_model(spark, sf_dir):
    return P.component_pivot(P.tool_calls(derived(spark, sf_dir)))


@query(f"with {CALLS} select tool, count(*) as n, count(feature) as named from c group by tool")
def calls_by_tool(spark, sf_dir):
    return P.tool_calls(derived(spark, sf_dir)).groupBy("tool").agg(
        F.count("*").alias("n"), F.count("feature").alias("named")
    )


_TOP = """(select feature, count(*) as n from c where component = 'shape_function'
    and feature is not null group by feature order by n desc, feature limit 20)"""


@query(f"with {CALLS} select * from {_TOP}")
def top_requested_features(spark, sf_dir):
    return P.top_requested(P.tool_calls(derived(spark, sf_dir)))


@query(f"""
    with {CALLS} select feature, category, count(*) as n from c
    where component = 'shape_function' and feature in (select feature from {_TOP}) group by all""")
def top_requested_by_category(spark, sf_dir):
    return P.requested_by_category(P.tool_calls(derived(spark, sf_dir)))


@query(f"""
    with {D} select count(*) filter (n_calls = 0) as zero_entries,
    round(avg({_RIGHT}) filter (n_calls = 0), 8) as zero_rate,
    round(avg({_RIGHT}) filter (grade is not null), 8) as all_rate from d""")
def accuracy_without_calls(spark, sf_dir):
    return rounded(P.zero_call_rates(derived(spark, sf_dir)), zero_rate=8, all_rate=8)


@query(f"""
    with {D} select event_id, model, dataset, template_id, grade, model_answer from d
    where n_calls = 0 order by event_id limit 5""")
def sample_without_calls(spark, sf_dir):
    return P.zero_call_sample(derived(spark, sf_dir), ["event_id"]).select(
        "event_id", "model", "dataset", "template_id", "grade", "model_answer"
    )


@query("""
    select role, count(*) as n, count(*) filter (coalesce(trim(text), '') = '') as blank
    from conversations group by role""")
def blank_turns_by_role(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(R.is_empty_answer(F.col("text"))).alias("blank")
    )


@query("""
    select 'orders' as source, o_orderstatus as status, null as kind, count(*) as n
    from orders group by all
    union all select 'part', null, p_type, count(*) from part group by all""")
def united_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source"), F.col("o_orderstatus").alias("status")
    )
    part = table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"), F.col("p_type").alias("kind")
    )
    return union_records(orders, part).groupBy("source", "status", "kind").agg(
        F.count("*").alias("n")
    )


FORMATS = ["categorical", "feature_ranked_list", "column_value", "column_pair", "row"]


def submissions(spark, sf_dir):
    """Parts asked back as answers, in every answer format and with the usual flaws."""
    k = F.col("p_partkey")
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")
    fmt = _from_list(FORMATS, k % 5)
    expected = (
        F.when(k % 5 == 0, kind).when(k % 5 == 1, F.concat_ws(", ", kind, brand, "p_name"))
        .when(k % 5 == 2, F.concat_ws(", ", kind, size)).when(k % 5 == 3, F.concat_ws(", ", brand, kind))
        .otherwise(F.concat_ws(", ", F.lit("YES"), size))
    )
    flaw = F.floor(k / 5) % 6
    answer = (
        F.when(flaw == 0, expected)
        .when(flaw == 1, F.concat(F.lit("["), F.upper(expected), F.lit(".0]")))
        .when(flaw == 2, F.concat_ws(", ", kind, F.lit("other")))
        .when(flaw == 3, F.lit("  "))
        .when(flaw == 4, F.concat(F.lit("ERROR: "), expected))
        .otherwise(F.concat_ws(", ", kind, brand))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", fmt.alias("answer_format"), expected.alias("expected_answer"),
        answer.alias("model_answer"),
    )


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[\\[\\]\"''`*]', '', 'g'), '\\.$', ''))"
_PARTS = (
    "list_transform(list_filter(list_transform(string_split(" + _NORM + ", ','), "
    "lambda p: trim(p)), lambda p: p <> ''), lambda p: coalesce(try_cast(p as double)::varchar, p))"
)


@query(f"""
    with made as (
        select *, p_partkey % 5 as f, (p_partkey // 5) % 6 as flaw,
               case p_partkey % 5 when 0 then p_type when 1 then p_type || ', ' || p_brand || ', '
                   || p_name when 2 then p_type || ', ' || p_size when 3 then p_brand || ', ' || p_type
                   else 'YES, ' || p_size end as expected
        from part),
    given as (
        select *, case flaw when 0 then expected when 1 then '[' || upper(expected) || '.0]'
                  when 2 then p_type || ', other' when 3 then '  '
                  when 4 then 'ERROR: ' || expected else p_type || ', ' || p_brand end as answer
        from made),
    split as (
        select *, {_PARTS.format('answer')} as g, {_PARTS.format('expected')} as w,
               ' ' || regexp_replace({_NORM.format('answer')}, '[^\\pL\\pN_.-]+', ' ', 'g') || ' '
                   as said,
               ' ' || regexp_replace({_NORM.format('expected')}, '[^\\pL\\pN_.-]+', ' ', 'g') || ' '
                   as sought
        from given)
    select p_partkey,
           case when flaw in (3, 4) then 'INCORRECT'
                when f = 0 then case when contains(said, sought) then 'CORRECT' else 'INCORRECT' end
                when f = 3 then case
                    when list_sort(list_distinct(g)) = list_sort(list_distinct(w)) then 'CORRECT'
                    when len(list_intersect(g, w)) > 0 then 'PARTIAL' else 'INCORRECT' end
                else case when g = w then 'CORRECT' when len(list_intersect(g, w)) > 0
                    then 'PARTIAL' else 'INCORRECT' end end as grade
    from split""")
def graded_answers(spark, sf_dir):
    return G.grade(submissions(spark, sf_dir)).select("p_partkey", "grade")


@query("""
    select case (p_partkey // 5) % 6 when 3 then 'no answer was given'
           when 4 then 'the request failed' else 'read' end as reasoning, count(*) as n
    from part group by 1""")
def automatic_grades(spark, sf_dir):
    reason = G.auto_grade(F.col("model_answer"))["reasoning"]
    return submissions(spark, sf_dir).groupBy(
        F.coalesce(reason, F.lit("read")).alias("reasoning")
    ).agg(F.count("*").alias("n"))
