"""Reports over graded evaluation records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import records as R
from tabprobe.operators.ranks import GROUP, group_key, medians

METRICS = ["total_latency_s", "ttft_s", "input_tokens", "output_tokens", "total_tokens"]

# The groupings of the accuracy report; each is one grouping set of a single pass.
ACCURACY_SETS = [
    ["model"], ["model", "run"], ["model", "template_id"], ["model", "template_id", "run"],
    ["template_id", "run"], ["model", "dataset_size"], ["model", "category"],
]
EMPTY_SETS = [[], ["model"], ["run"], ["model", "run"], ["dataset"]]


def derive(results: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Add provider, category, table size, flat metrics, empty and error flags, call count.

    ``categories(template_id, category)`` has a row per template; a template without one is
    ``other``.
    """
    m = F.col("metrics")
    whole = F.coalesce(m["input_tokens"], F.lit(0)) + F.coalesce(m["output_tokens"], F.lit(0))
    empty = R.is_empty_answer(F.col("model_answer"))
    out = results.withColumns({
        "provider": R.provider(F.col("model")),
        "dataset_size": R.dataset_size(F.col("dataset")),
        "input_tokens": m["input_tokens"], "output_tokens": m["output_tokens"],
        "ttft_s": m["ttft_s"], "total_latency_s": m["total_latency_s"],
        "total_tokens": whole,
        "is_empty": empty,
        "is_error": empty | F.col("grade").isNull(),
        "n_calls": F.coalesce(F.when(F.col("tool_use").isNotNull(), F.size("tool_use")), F.lit(0)),
    }).withColumn("size", F.col("dataset_size").cast("string"))
    if categories is not None:
        out = out.drop("category").join(categories, "template_id", "left")
    return out.withColumn("category", F.coalesce("category", F.lit("other")))


def _sets(df: DataFrame, sets: list[list[str]], counted: dict[str, Column]) -> DataFrame:
    """Sums of 0/1 columns over several groupings; ``grouping`` names the grouping columns.

    Records are first summed by all the columns together, so the grouping sets repeat the few
    combinations that occur and not the records.
    """
    names = sorted({n for s in sets for n in s}, key=lambda n: [n in s for s in sets], reverse=True)
    finest = df.groupBy(*names).agg(
        F.count("*").alias("n"), *[F.sum(c.cast("bigint")).alias(k) for k, c in counted.items()]
    )
    used = F.concat_ws(",", *[F.when(F.grouping(n) == 0, F.lit(n)) for n in names])
    return finest.groupingSets(
        [[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names]
    ).agg(used.alias("grouping"), F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in counted])


def is_correct() -> Column:
    """Graded CORRECT; a missing grade counts as wrong."""
    return F.coalesce(F.col("grade") == "CORRECT", F.lit(False))


def accuracy_cube(
    results: DataFrame, drop_empty: bool = True, sets: list[list[str]] = ACCURACY_SETS
) -> DataFrame:
    kept = results.where(~F.col("is_empty")) if drop_empty else results
    sums = _sets(kept, sets, {"correct": is_correct().cast("int")})
    return sums.withColumn("accuracy", F.col("correct") / F.col("n")).drop("correct")


def grade_pivot(results: DataFrame, with_empty: bool = False) -> DataFrame:
    """Counts per model and grade in fixed order; ungraded rows as EMPTY, or left out."""
    grades = [*R.GRADES, "EMPTY"] if with_empty else R.GRADES
    kept = results if with_empty else results.where(~F.col("is_empty"))
    grade = F.coalesce("grade", F.lit("EMPTY"))
    return kept.groupBy("model").agg(*[F.count_if(grade == g).alias(g) for g in grades])


def empty_rates(results: DataFrame) -> DataFrame:
    sums = _sets(results, EMPTY_SETS, {"empty": F.col("is_empty").cast("int")})
    return sums.withColumnRenamed("n", "total").withColumn("rate", F.col("empty") / F.col("total"))


def metric_medians(
    results: DataFrame, by: list[str], metrics: list[str] = METRICS, drop_errors: bool = True,
    **sizing,
) -> DataFrame:
    """Median of each metric per group, rounded to two places, with the number of values."""
    kept = results.where(~F.col("is_error")) if drop_errors else results
    long = kept.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        by, metrics, "metric", "value"
    ).where(F.col("value").isNotNull())
    counts = long.groupBy(*by, "metric").agg(F.count("*").alias("n"))
    middle = medians(long, [*by, "metric"], "value", **sizing)
    key = group_key([*by, "metric"])  # a null in it is a value like any other
    return counts.withColumn(GROUP, key).join(middle.select(key, "median"), GROUP).select(
        *by, "metric", "n", F.round("median", 2).alias("median")
    )


def token_medians(results: DataFrame, **sizing) -> DataFrame:
    """Per template and run: median input tokens plus median output tokens (missing output as 0)."""
    kept = results.where(~F.col("is_error")).withColumn(
        "output_tokens", F.coalesce("output_tokens", F.lit(0))
    )
    both = metric_medians(
        kept, ["template_id", "run"], ["input_tokens", "output_tokens"], False, **sizing
    )
    return both.groupBy("template_id", "run").agg(
        F.sum(F.when(F.col("metric") == "input_tokens", F.col("median"))).alias("input_median"),
        F.sum(F.when(F.col("metric") == "output_tokens", F.col("median"))).alias("output_median"),
    ).where(F.col("input_median").isNotNull()).withColumn(
        "tokens", F.col("input_median") + F.col("output_median")
    )


def overview(results: DataFrame) -> DataFrame:
    """Record, model, run and template counts, and how many answers are empty or kept."""
    return results.agg(
        F.count("*").alias("records"), F.count_distinct("model").alias("models"),
        F.count_distinct("run").alias("runs"), F.count_distinct("template_id").alias("templates"),
        F.count_if("is_empty").alias("empty"), F.count_if(~F.col("is_empty")).alias("kept"),
    )


def model_template_counts(results: DataFrame, templates: list[str]) -> DataFrame:
    """Records per model, one column per template, 0 where there are none."""
    return results.groupBy("model").agg(*[
        F.count_if(F.col("template_id") == t).alias(t) for t in templates
    ])


def grade_summary(results: DataFrame) -> DataFrame:
    """Per model: correct, partial, incorrect and all records."""
    return results.groupBy("model").agg(
        *[F.count_if(F.col("grade") == g).alias(g.lower()) for g in R.GRADES],
        F.count("*").alias("n"),
    )


def tool_calls(results: DataFrame) -> DataFrame:
    """One row per tool call; an input that is not a record counts as empty."""
    calls = results.select(
        "model", "template_id", "category", "dataset", "run", "grade", F.explode("tool_use").alias("c")
    )
    given = F.from_json(F.col("c.input"), "component string, feature string")
    return calls.select(
        "model", "template_id", "category", "dataset", "run", "grade",
        F.coalesce("c.tool", F.lit("?")).alias("tool"),
        F.coalesce(given["component"], F.lit("?")).alias("component"),
        given["feature"].alias("feature"),
    )


def call_stats(results: DataFrame, by: list[str], **sizing) -> DataFrame:
    """Tool calls per record: median, mean, maximum, and records without any call."""
    stats = results.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("n_calls").alias("calls"),
        F.avg("n_calls").alias("mean"), F.max("n_calls").alias("most"),
        F.count_if(F.col("n_calls") == 0).alias("zero_calls"),
    )
    middle = medians(results, by, "n_calls", **sizing)
    if not by:
        return stats.crossJoin(F.broadcast(middle))
    same = reduce(lambda a, b: a & b, [stats[c].eqNullSafe(middle[c]) for c in by])
    return stats.join(middle, same).select(*[stats[c] for c in stats.columns], "median")


def call_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("model", "n_calls").agg(F.count("*").alias("n"))


def component_counts(calls: DataFrame) -> DataFrame:
    """Calls by component, over all models (model is null) and per model."""
    return _sets(calls, [["component"], ["model", "component"]], {})


def component_pivot(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(*[
        F.count_if(F.col("component") == c).alias(c) for c in R.COMPONENTS
    ])


def top_requested(calls: DataFrame, n: int = 20) -> DataFrame:
    """The features asked for most in shape-function calls; equal counts go by name."""
    asked = calls.where((F.col("component") == "shape_function") & F.col("feature").isNotNull())
    return asked.groupBy("feature").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "feature"
    ).limit(n)


def requested_by_category(calls: DataFrame, n: int = 20) -> DataFrame:
    """Calls per category for the most requested features only."""
    top = F.broadcast(top_requested(calls, n).select("feature"))  # at most n rows
    asked = calls.where(F.col("component") == "shape_function").join(top, "feature", "left_semi")
    return asked.groupBy("feature", "category").agg(F.count("*").alias("n"))


def zero_call_rates(results: DataFrame) -> DataFrame:
    """Correct rate of the records without tool calls, against all graded records."""
    zero = F.col("n_calls") == 0
    right = is_correct().cast("double")
    return results.agg(
        F.count_if(zero).alias("zero_entries"),
        F.avg(F.when(zero, right)).alias("zero_rate"),
        F.avg(F.when(F.col("grade").isNotNull(), right)).alias("all_rate"),
    )


def zero_call_sample(results: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return results.where(F.col("n_calls") == 0).orderBy(*order).limit(n)
