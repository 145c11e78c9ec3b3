"""Matching question templates to profiled tables, as joins over the whole catalog.

Templates and profiles are catalog-sized (a row per template, a row per table column). Only the
distinct values of the columns that a value slot needs grow with the data; they stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.draws import digest
from tabprobe.functions.text import render_question, resolve_params
from tabprobe.operators.ranks import order_statistics
from tabprobe.sources.shared import cut

_PAIR = ["dataset", "template_id"]
_PREFIX = 4  # hex digits of a digest: 65 536 buckets a column


def slot_rows(templates: DataFrame) -> DataFrame:
    """One row per (template, slot), with the slot's place in the template."""
    return templates.select("template_id", F.posexplode("slots").alias("slot_at", "s")).select(
        "template_id", "slot_at", "s.*"
    )


def fits() -> Column:
    """Whether a profile column satisfies a slot; a limit that is not set does not bind."""
    def listed(allowed: str, value: str) -> Column:
        return F.col(allowed).isNull() | F.array_contains(F.col(allowed), F.col(value))

    return (
        listed("kind_any_of", "kind") & listed("dtype_any_of", "dtype")
        & F.coalesce(F.col("unique_count") >= F.col("unique_count_min"), F.lit(True))
        & F.coalesce(F.col("unique_count") <= F.col("unique_count_max"), F.lit(True))
    )


def slot_matches(templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per (dataset, template, slot): matching columns in name order, and why there are none."""
    slots = slot_rows(templates)
    datasets = profiles.groupBy("dataset").agg(
        F.max(F.when(F.col("is_target"), F.col("column"))).alias("target")
    )
    columns = slots.where(F.col("type") == "column")
    hits = (
        profiles.join(F.broadcast(columns), fits())
        .where((F.coalesce("source", F.lit("")) != "dataset.target") | F.col("is_target"))
        .groupBy("dataset", "template_id", "slot")
        .agg(F.array_sort(F.collect_list("column")).alias("matches"))
    )
    every = datasets.crossJoin(F.broadcast(slots))
    found = every.join(hits, [*_PAIR, "slot"], "left")
    sources = found.where(F.col("type") == "column").select(
        *_PAIR, F.col("slot").alias("source_column"), F.col("matches").alias("source_matches")
    )
    found = found.join(sources, [*_PAIR, "source_column"], "left")
    is_column, is_value = F.col("type") == "column", F.col("source") == "column_values"
    from_target = is_column & (F.col("source") == "dataset.target")
    name = F.concat(F.lit("slot "), F.col("slot"))
    none = F.col("matches").isNull()
    reason = (
        F.when(from_target & F.col("target").isNull(), F.concat(name, F.lit(": no target")))
        .when(from_target & none, F.concat(name, F.lit(": target "), "target", F.lit(" does not fit")))
        .when(is_column & none, F.concat(name, F.lit(": no column fits")))
        .when(is_value & F.col("source_column").isNull(), F.concat(name, F.lit(": no source column")))
        .when(is_value & F.col("source_matches").isNull(),
              F.concat(name, F.lit(": source slot "), "source_column", F.lit(" has no column")))
    )
    return found.withColumn("reason", reason)


def feature_pools(templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per (dataset, template): the columns its feature pool leaves, in table order."""
    pool = templates.select("template_id", "feature_pool.*")
    kept = (
        ~(F.coalesce("exclude_target", F.lit(False)) & F.col("is_target"))
        & ~F.coalesce(F.array_contains("exclude_kinds", F.col("kind")), F.lit(False))
        & ~F.coalesce(F.array_contains("exclude_dtypes", F.col("dtype")), F.lit(False))
    )
    return profiles.join(F.broadcast(pool)).groupBy(*_PAIR).agg(
        F.array_sort(F.collect_list(F.when(kept, F.col("column")))).alias("feature_pool")
    )


def requirement_counts(templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per (dataset, template, requirement): how many columns count towards it, and the minimum."""
    needs = templates.select(
        "template_id", "feature_pool", F.posexplode("requirements").alias("need_at", "need")
    ).select(
        "template_id", "need_at", "feature_pool.*",
        F.col("need.type").alias("need_type"), F.col("need.kind").alias("need_kind"),
        F.col("need.dtype").alias("need_dtype"), F.col("need.dtypes").alias("need_dtypes"),
        F.coalesce(F.col("need.min"), F.lit(0)).alias("need_min"),
    )
    in_pool = (
        ~(F.coalesce("exclude_target", F.lit(False)) & F.col("is_target"))
        & ~F.coalesce(F.array_contains("exclude_kinds", F.col("kind")), F.lit(False))
        & ~F.coalesce(F.array_contains("exclude_dtypes", F.col("dtype")), F.lit(False))
    )
    counts = (
        F.when(F.col("need_type") == "min_feature_count", in_pool)
        .when(F.col("need_type") == "min_count_by_kind", F.col("kind") == F.col("need_kind"))
        .when(F.col("need_type") == "min_count_by_dtype", F.col("dtype") == F.col("need_dtype"))
        .when(F.col("need_type") == "min_count_by_dtype_any_of",
              F.array_contains("need_dtypes", F.col("dtype")))
        .otherwise(F.lit(False))
    )
    what = (
        F.when(F.col("need_type") == "min_count_by_kind", F.concat(F.lit("kind "), "need_kind"))
        .when(F.col("need_type") == "min_count_by_dtype", F.concat(F.lit("type "), "need_dtype"))
        .when(F.col("need_type") == "min_count_by_dtype_any_of",
              F.concat(F.lit("type "), F.concat_ws(" or ", "need_dtypes")))
        .otherwise(F.lit("feature"))
    )
    return profiles.join(F.broadcast(needs)).groupBy(*_PAIR, "need_at").agg(
        F.first("need_type").alias("need_type"), F.first(what).alias("what"),
        F.first("need_min").alias("need_min"), F.count_if(counts).alias("held"),
    )


def check_requirements(
    templates: DataFrame, profiles: DataFrame, found: DataFrame | None = None
) -> DataFrame:
    """Per (dataset, template): ``compatible`` and the ordered list of reasons against it.

    ``found`` may pass in the result of :func:`slot_matches`.
    """
    found = slot_matches(templates, profiles) if found is None else found
    slots = found.select(
        *_PAIR, F.when(F.col("type") == "column", 0).otherwise(1).alias("stage"),
        F.col("slot_at").alias("at"), "reason",
    )
    known = F.col("need_type").isin(
        "min_feature_count", "min_count_by_kind", "min_count_by_dtype", "min_count_by_dtype_any_of"
    )
    needs = requirement_counts(templates, profiles).select(
        *_PAIR, F.lit(2).alias("stage"), F.col("need_at").alias("at"),
        F.when(known & (F.col("held") < F.col("need_min")),
               F.format_string("needs %d of %s, has %d", "need_min", "what", "held")).alias("reason"),
    )
    # collect_list skips nulls, so only real reasons stay.
    return slots.unionByName(needs).groupBy(*_PAIR).agg(
        F.array_sort(F.collect_list(
            F.when(F.col("reason").isNotNull(), F.struct("stage", "at", "reason"))
        )).alias("found")
    ).select(
        *_PAIR, (F.size("found") == 0).alias("compatible"), F.col("found.reason").alias("reasons")
    )


def applicable(templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """The (dataset, template) pairs without a reason against them."""
    return check_requirements(templates, profiles).where("compatible").select(*_PAIR)


def assign_columns(found: DataFrame, usable: DataFrame) -> DataFrame:
    """Column slots of every usable pair: ``(dataset, template_id, assigned map)``.

    ``found`` comes from :func:`slot_matches`, ``usable`` from :func:`applicable`. Target slots
    come first; then each slot takes its first matching column that is still free.
    """
    matches = found.join(usable, _PAIR, "left_semi")
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "column", F.struct(
        F.when(F.col("source") == "dataset.target", 0).otherwise(1).alias("late"),
        "slot_at", "slot", F.coalesce("matches", F.array().cast("array<string>")).alias("matches"),
    ))))
    start = F.struct(
        F.array().cast("array<string>").alias("slots"), F.array().cast("array<string>").alias("taken")
    )

    def take(state: Column, spec: Column) -> Column:
        free = F.when(spec["late"] == 0, spec["matches"]).otherwise(
            F.array_except(spec["matches"], state["taken"])
        )
        found = F.get(free, F.lit(0))
        return F.struct(
            F.when(found.isNull(), state["slots"]).otherwise(
                F.array_append(state["slots"], spec["slot"])).alias("slots"),
            F.when(found.isNull(), state["taken"]).otherwise(
                F.array_append(state["taken"], found)).alias("taken"),
        )

    return matches.groupBy(*_PAIR).agg(ordered.alias("ordered")).select(
        *_PAIR, F.aggregate("ordered", start, take).alias("done")
    ).select(*_PAIR, F.map_from_arrays("done.slots", "done.taken").alias("assigned"))


Values = Callable[[list[tuple[str, str]]], DataFrame]


def pick_values(needed: DataFrame, values: Values, seed: int) -> DataFrame:
    """Values for the value slots ``needed(dataset, template_id, slot, column, position, turn)``.

    Random slots of one template that read the same column get different values: the smallest
    keyed digests in turn. A middle slot takes the middle value in text order.
    ``values`` is called with the (dataset, column) pairs that are needed, a few per table, and
    gives ``(dataset, column, value)`` with repeats; no other column is read.
    """
    key = ["dataset", "column"]
    is_middle = F.col("position") == "middle"
    asked = needed.groupBy(*key).agg(
        F.bool_or(is_middle).alias("middle"), F.bool_or(~is_middle).alias("random")
    ).orderBy(*key).collect()
    picks = [needed.select(*_PAIR, "slot", F.lit(None).cast("string").alias("value")).limit(0)]
    random_pairs = [(r["dataset"], r["column"]) for r in asked if r["random"]]
    if random_pairs:
        randoms = needed.where(~is_middle)
        turns = randoms.groupBy(*_PAIR, "column").agg(F.max("turn").alias("most"))
        draw = digest(seed, "value", F.concat_ws("|", "dataset", "template_id", "column", "value"))
        order = Window.partitionBy(*_PAIR, "column").orderBy("draw", "value")
        drawn = _distinct(values(random_pairs)).join(F.broadcast(turns), key).select(
            *_PAIR, "column", "value", "most", draw.alias("draw"))
        # Only the few values whose digests can be among the smallest are sorted.
        drawn = _first_buckets(drawn, [*_PAIR, "column"]).withColumn(
            "turn", F.row_number().over(order)).where(F.col("turn") <= F.col("most"))
        picks.append(
            randoms.join(drawn, [*_PAIR, "column", "turn"]).select(*_PAIR, "slot", "value")
        )
    middle_pairs = [(r["dataset"], r["column"]) for r in asked if r["middle"]]
    if middle_pairs:
        sought = _distinct(values(middle_pairs))
        wanted = sought.groupBy(*key).agg(F.floor(F.count("*") / 2).cast("bigint").alias("k"))
        centre = order_statistics(sought, key, "value", wanted)
        picks.append(needed.where(is_middle).join(centre, key).select(*_PAIR, "slot", "value"))
    return reduce(DataFrame.unionByName, picks)


def _first_buckets(drawn: DataFrame, group: list[str]) -> DataFrame:
    """Rows in the buckets, by digest prefix, that hold the ``most`` smallest digests of a group.

    Counts by prefix show in which bucket they end; all others are left out before any shuffle.
    """
    prefix = F.substring("draw", 1, _PREFIX)
    upto = Window.partitionBy(*group).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        drawn.groupBy(*group, "most", prefix.alias("prefix")).agg(F.count("*").alias("held"))
        .withColumn("ahead", F.coalesce(F.sum("held").over(upto), F.lit(0)))
        .where(F.col("ahead") < F.col("most"))
        .groupBy(*group).agg(F.max("prefix").alias("last"))
    )
    return drawn.join(F.broadcast(last), group).where(prefix <= F.col("last")).drop("last")


def _distinct(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").isNotNull()).distinct()


def assign_slots(
    templates: DataFrame, found: DataFrame, usable: DataFrame, values: Values, seed: int
) -> DataFrame:
    """All slots of every usable pair: ``(dataset, template_id, slots map<string,string>)``."""
    columns = cut(assign_columns(found, usable).select(
        *_PAIR, F.explode("assigned").alias("slot", "value")
    ))
    slots = slot_rows(templates)
    turn = Window.partitionBy(*_PAIR, "column").orderBy("slot_at")
    needed = cut(slots.where(F.col("source") == "column_values").join(
        columns.select(*_PAIR, F.col("slot").alias("source_column"), F.col("value").alias("column")),
        ["template_id", "source_column"],
    ).select(
        *_PAIR, "slot", "column", F.coalesce("position", F.lit("random")).alias("position"),
        F.row_number().over(turn).alias("turn"),
    ))
    scalars = usable.join(
        F.broadcast(slots.where(F.col("type").isin("int", "float", "string"))), "template_id"
    ).select(*_PAIR, "slot", F.coalesce("default", "min").alias("value"))
    chosen = columns.unionByName(cut(pick_values(needed, values, seed)))
    chosen = chosen.unionByName(
        scalars.join(chosen, [*_PAIR, "slot"], "left_anti").where(F.col("value").isNotNull())
    )
    return chosen.groupBy(*_PAIR).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "value")))).alias("slots")
    )


def match_all(
    templates: DataFrame, profiles: DataFrame, values: Values, seed: int,
    template_ids: list[str] | None = None,
) -> DataFrame:
    """Every (dataset, template): compatibility, reasons, slots, feature pool, question.

    The steps share catalog-sized tables; each is computed once and checkpointed.
    """
    if template_ids:
        templates = templates.where(F.col("template_id").isin(template_ids))
    profiles = cut(profiles)
    found = cut(slot_matches(templates, profiles))
    checked = cut(check_requirements(templates, profiles, found))
    usable = checked.where("compatible").select(*_PAIR)
    empty = F.create_map().cast("map<string,string>")
    slots = F.coalesce("slots", empty)
    return (
        checked
        .join(assign_slots(templates, found, usable, values, seed), _PAIR, "left")
        .join(feature_pools(templates, profiles), _PAIR, "left")
        .join(F.broadcast(templates.select(
            "template_id", "category", "answer_format", "phenomena", "question"
        )), "template_id")
        .select(
            *_PAIR, "category", "answer_format", "compatible", "reasons", slots.alias("slots"),
            "feature_pool", render_question(F.col("question"), slots).alias("question"), "phenomena",
        )
    )


def template_phenomena(matches: DataFrame) -> DataFrame:
    """Per compatible pair and phenomenon: the injector with its parameters filled in."""
    rows = matches.where("compatible").select(
        *_PAIR, "slots", F.explode("phenomena").alias("p")
    )
    params = resolve_params(F.coalesce("p.param_mapping", F.create_map().cast("map<string,string>")),
                            F.col("slots"))
    return rows.select(*_PAIR, F.col("p.injector").alias("injector"), params.alias("params")).withColumn(
        "params_key", params_key(F.col("params"))
    )


def params_key(params: Column) -> Column:
    """Parameters as one text, the same for any order of entry."""
    return F.to_json(F.array_sort(F.map_entries(params)))


def required_phenomena(matches: DataFrame) -> DataFrame:
    """Distinct injections per dataset, with the templates that ask for each."""
    return template_phenomena(matches).groupBy("dataset", "injector", "params_key").agg(
        F.any_value("params").alias("params"),
        F.array_sort(F.collect_set("template_id")).alias("templates"),
    )


def qa_pairs(matches: DataFrame, effects: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with slots and answers, one row per (dataset, template) of an injection.

    ``effects`` is ``(dataset, injector, params_key, ...)``; a question is only asked of the
    injection whose parameters it filled in.
    """
    return (
        template_phenomena(matches)
        .join(effects, ["dataset", "injector", "params_key"], "left")
        .join(answers, ["dataset", "injector", "params_key", "template_id"], "left")
        .join(matches.select(*_PAIR, "category", "answer_format", "question", "slots"), _PAIR)
    )


def run_report(matches: DataFrame, effects: DataFrame, answers: DataFrame) -> DataFrame:
    """One status per (dataset, injector, template): OK, SKIP or NO MATCH, with the reason.

    ``effects`` has ``status, reason`` of each injection, ``answers`` of each answer.
    """
    asked = qa_pairs(
        matches, effects.withColumnRenamed("status", "injected").withColumnRenamed("reason", "why"),
        answers.withColumnRenamed("status", "answered").withColumnRenamed("reason", "gap"),
    )
    skipped = (
        F.when(F.col("injected").isNull(), F.lit("not injected"))
        .when(F.col("injected") != "OK", F.col("why"))
        .when(F.coalesce("answered", F.lit("ERROR")) != "OK", F.coalesce("gap", F.lit("no answer")))
    )
    done = asked.select(
        "dataset", "injector", "template_id",
        F.when(skipped.isNull(), "OK").otherwise("SKIP").alias("status"),
        F.coalesce(skipped, F.lit("")).alias("reason"),
    )
    unmatched = matches.where(~F.col("compatible")).select(
        "dataset", F.coalesce(F.get(F.col("phenomena.injector"), F.lit(0)), F.lit("-")).alias("injector"),
        "template_id", F.lit("NO MATCH").alias("status"),
        F.array_join("reasons", "; ").alias("reason"),
    )
    return done.unionByName(unmatched)
