"""Ground-truth answers for the questions of many instances at once.

Every kind of answer is one grouped aggregate over (question, ...), whatever the number of
instances: a scan reads the tables of all of them under their places (see
:mod:`tabprobe.sources.stacked`), a question knows the places of its columns, and the rows of its
instance are the rows it is joined to. Results and reasons are those of
:mod:`tabprobe.operators.answers` for one table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.operators.answers import ALPHA, ANSWERS, MAX_GAP
from tabprobe.operators.columns import falls_along
from tabprobe.operators.moments import _t_tail
from tabprobe.operators.ranks import group_sizes, medians, quantiles, value_ranks
from tabprobe.operators.shapes import bin_of, shape_scores
from tabprobe.sources.shared import cut
from tabprobe.sources.stacked import (
    each_cell, equals, is_number, may_be_number, number_of, period, text_of,
)

#: What answers need of the effects, of any injector.
EFFECTS = """
    indicator_col string, risky_group string, change_row_id string, peak_feature string,
    peak_value string, feat_a string, feat_b string, injected_feature string,
    id_no_cols array<string>
"""
#: Questions that are sent to every task at most; a question is a few hundred bytes.
MOST_SENT = 50_000
_MIN_UNIQUE = 10
_BINS = 5


def _column(name: Column) -> Column:
    """The record of a column by its name, null where the table has none."""
    return F.get(F.filter("columns", lambda c: c["name"] == name), F.lit(0))


def _slot(name: str) -> Column:
    return F.element_at("slots", name)


def _features(keep: Callable[[Column], Column]) -> Column:
    """Records of some columns with their place in the table, in table order."""
    placed = F.transform("columns", lambda c, i: F.struct(
        c["name"].alias("name"), c["type"].alias("type"), c["kind"].alias("kind"),
        c["at"].alias("at"), i.alias("position")))
    return F.filter(placed, keep)


class _Asked:
    """Questions of one kind, and the rows of their instances."""

    def __init__(self, questions: DataFrame, rows: DataFrame, few: bool):
        self.questions = questions
        self._rows, self._few = rows, few

    def joined(self, *wanted: Column) -> DataFrame:
        """A row for each question and row of its instance, with what is asked of the question."""
        own = self.questions.select("question", "instance", *wanted)
        return self._rows.join(F.broadcast(own) if self._few else own, "instance")


def _verdict(*cases: tuple[Column, Column]) -> Column:
    """The reason of the first case that holds, else null."""
    found = F.lit(None).cast("string")
    for test, reason in reversed(cases):
        found = F.when(F.coalesce(test, F.lit(False)), reason).otherwise(found)
    return found


def _top(scores: DataFrame, score: Column) -> DataFrame:
    """Names of the best scored features of each question, joined; (question, answer)."""
    order = Window.partitionBy("question").orderBy(score.desc(), "position")
    best = scores.where(score.isNotNull()).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= F.col("k"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return best.groupBy("question").agg(F.array_join(listed["name"], ", ").alias("answer"))


def _scored_features(asked: _Asked) -> DataFrame:
    """(question, k, position, name, x, y) of every row and feature that has both numbers."""
    outcome = _column(_slot("OUTCOME_COL"))
    own = _features(lambda c: may_be_number(c) & (c["name"] != _slot("OUTCOME_COL"))
                    & ~F.array_contains(F.coalesce("effects.id_no_cols", F.array().cast(
                        "array<string>")), c["name"]))
    rows = asked.joined(
        outcome.alias("outcome"), own.alias("features"),
        F.coalesce(_slot("K"), F.lit("5")).cast("int").alias("k"))
    return each_cell(
        rows, "features", "question", "k", number_of(F.col("outcome")).alias("y"),
        text_of(F.col("outcome")).alias("outcome"),
    ).select("question", "k", "y", "outcome", "cell.position", "cell.name",
             number_of(F.col("cell")).alias("x"))


def _by_correlation(asked: _Asked) -> DataFrame:
    both = _scored_features(asked).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    scores = both.groupBy("question", "k", "position", "name").agg(
        F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("r"))
    return _named(asked, _top(scores, F.abs("r")))


def _by_auroc(asked: _Asked) -> DataFrame:
    outcome = asked.joined(_column(_slot("OUTCOME_COL")).alias("outcome")).select(
        "question", number_of(F.col("outcome")).alias("y"),
        text_of(F.col("outcome")).alias("outcome"))
    split = cut(outcome.groupBy("question").agg(
        (F.count_distinct("outcome") > 2).alias("many"))
        .join(medians(outcome.select("question", "y"), ["question"], "y"), "question", "left"))
    cells = _scored_features(asked).where(F.col("x").isNotNull()).join(
        asked_side(split), "question")
    label = F.when(F.col("many"), F.coalesce((F.col("y") >= F.col("median")).cast("int"), F.lit(0))
                   ).otherwise(F.col("y").cast("int"))
    long = cells.withColumn("label", label).where(F.col("label").isin(0, 1)).select(
        "question", "position", "x", "label")
    ranked = value_ranks(long, ["question", "position"], "x", [F.sum("label").alias("positives")])
    sums = ranked.groupBy("question", "position").agg(
        F.sum(F.col("mid_rank") * F.col("positives")).alias("rank_sum"),
        F.sum("positives").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("n0"))
    area = F.try_divide(F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2,
                        F.col("n1") * F.col("n0"))
    names = asked.questions.select(
        "question", F.coalesce(_slot("K"), F.lit("5")).cast("int").alias("k"),
        F.posexplode("columns").alias("position", "c")).select(
        "question", "k", "position", "c.name")
    scores = sums.select("question", "position", F.greatest(area, 1 - area).alias("auroc")).join(
        names, ["question", "position"])
    return _named(asked, _top(scores, F.col("auroc")))


def asked_side(table: DataFrame) -> DataFrame:
    """A stored table with a row per question or (question, column), sent out where it is small."""
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _named(asked: _Asked, answers: DataFrame) -> DataFrame:
    """Every question has a list of names, if an empty one."""
    return asked.questions.select("question").join(answers, "question", "left").select(
        "question", F.coalesce("answer", F.lit("")).alias("answer"),
        F.lit(None).cast("string").alias("gap"))


def _bad_rows(asked: _Asked) -> DataFrame:
    found = F.col("effects.indicator_col")
    return asked.questions.select(
        "question", found.alias("answer"),
        _verdict((found.isNull(), F.lit("no bad-row effect"))).alias("gap"))


def _retrain_point(asked: _Asked) -> DataFrame:
    start = F.col("effects.change_row_id")
    return asked.questions.select(
        "question", F.when(start.isNull(), "NO").otherwise(F.concat(F.lit("YES, "), start))
        .alias("answer"), F.lit(None).cast("string").alias("gap"))


@F.pandas_udf(T.DoubleType())
def _p_values(f_stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Tail probability of F(1, dof), a row per question."""
    known = f_stat.notna() & (dof > 0)
    return pd.Series([_t_tail(f, d) if k else None for f, d, k in zip(f_stat, dof, known)],
                     dtype="float64")


def _riskier_group(asked: _Asked) -> DataFrame:
    rows = asked.joined(
        _column(_slot("GROUP_COL")).alias("group"), _column(_slot("RISK_METRIC_COL")).alias("metric"),
        _slot("GROUP_A").alias("a"), _slot("GROUP_B").alias("b"))
    side = F.when(equals(F.col("group"), F.col("a")), "a").when(
        equals(F.col("group"), F.col("b")), "b")
    tagged = rows.select("question", side.alias("side"), number_of(F.col("metric")).alias("x")
                         ).where(F.col("side").isNotNull())
    in_a, in_b = (F.when(F.col("side") == s, F.col("x")) for s in "ab")
    gaps = tagged.groupBy("question").agg(
        F.avg(in_a).alias("mean_a"), F.avg(in_b).alias("mean_b"),
        F.var_samp(in_a).alias("var_a"), F.var_samp(in_b).alias("var_b"),
        F.stddev_samp("x").alias("pooled"))
    seen = tagged.where(F.col("x").isNotNull())
    centres = cut(medians(seen, ["question", "side"], "x"))
    spread = seen.join(asked_side(centres), ["question", "side"]).withColumn(
        "z", F.abs(F.col("x") - F.col("median")))
    z_a, z_b = (F.when(F.col("side") == s, F.col("z")) for s in "ab")
    sums = spread.groupBy("question").agg(
        F.count(z_a).alias("n_a"), F.count(z_b).alias("n_b"), F.avg(z_a).alias("z_a"),
        F.avg(z_b).alias("z_b"), F.avg("z").alias("z_all"), F.var_pop(z_a).alias("v_a"),
        F.var_pop(z_b).alias("v_b"))
    between = F.col("n_a") * F.pow(F.col("z_a") - F.col("z_all"), 2) + F.col("n_b") * F.pow(
        F.col("z_b") - F.col("z_all"), 2)
    within = F.col("n_a") * F.col("v_a") + F.col("n_b") * F.col("v_b")
    dof = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    tests = sums.select("question", F.try_divide(dof * between, within).alias("f"), dof.alias("dof"))
    found = asked.questions.select(
        "question", _slot("GROUP_A").alias("a"), _slot("GROUP_B").alias("b"),
        _slot("RISK_METRIC_COL").alias("metric"), F.col("effects.risky_group").alias("truth"),
    ).join(gaps, "question", "left").join(tests, "question", "left").withColumn(
        "p", _p_values("f", "dof"))
    riskier = F.when(F.coalesce("var_a", F.lit(0.0)) > F.coalesce("var_b", F.lit(0.0)), F.col("a")
                     ).otherwise(F.col("b"))
    gap = F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), F.col("pooled"))
    return found.select("question", riskier.alias("answer"), _verdict(
        (F.coalesce("pooled", F.lit(0.0)) == 0,
         F.concat(F.lit("column "), "metric", F.lit(" is constant over both groups"))),
        (gap > MAX_GAP, F.lit("group means differ")),
        (F.col("p") > ALPHA, F.lit("variances do not differ")),
        (F.col("truth").isNull(), F.lit("missing 'dq_riskier_group'")),
        (riskier != F.col("truth"),
         F.concat(F.lit("group "), riskier, F.lit(" varies more than the injected one"))),
    ).alias("gap"))


def _performance(asked: _Asked) -> DataFrame:
    rows = asked.joined(
        _column(_slot("GROUP_COL")).alias("group"), _column(_slot("TIME_COL")).alias("time"),
        _column(_slot("OUTCOME_COL")).alias("outcome"), _slot("SPECIFIC_DATE").alias("split"))
    cells = rows.select(
        "question", text_of(F.col("group")).alias("grp"),
        period(F.col("time"), F.col("split")).alias("period"),
        number_of(F.col("outcome")).alias("y"))
    in_a, in_b = F.col("period") == "A", F.col("period") == "B"
    # Groups first: a row per (question, group), however many rows it has.
    means = cells.groupBy("question", "grp").agg(
        F.count_if(in_a).alias("rows_a"), F.count_if(in_b).alias("rows_b"),
        F.count(F.when(in_a, F.col("y"))).alias("n_a"), F.count(F.when(in_b, F.col("y"))).alias("n_b"),
        F.avg(F.when(in_a, F.col("y"))).alias("mean_a"),
        F.avg(F.when(in_b, F.col("y"))).alias("mean_b"))
    both = F.col("grp").isNotNull() & (F.col("rows_a") > 0) & (F.col("rows_b") > 0)
    found = means.groupBy("question").agg(
        F.sum("rows_a").alias("rows_a"), F.sum("rows_b").alias("rows_b"),
        F.count_if(both).alias("groups"),
        F.count_if(both & (F.col("mean_b") > F.col("mean_a"))).alias("improved"),
        F.count_if(both & (F.col("mean_b") < F.col("mean_a"))).alias("worsened"),
        F.try_divide(F.sum(F.col("n_a") * F.col("mean_a")), F.sum("n_a")).alias("all_a"),
        F.try_divide(F.sum(F.col("n_b") * F.col("mean_b")), F.sum("n_b")).alias("all_b"))
    found = asked.questions.select("question").join(found, "question", "left")
    within = F.when(F.col("improved") == F.col("groups"), "IMPROVED").when(
        F.col("worsened") == F.col("groups"), "WORSENED").otherwise("MIXED")
    overall = F.when(F.col("all_b") > F.col("all_a"), "IMPROVED").when(
        F.col("all_b") < F.col("all_a"), "WORSENED").otherwise("UNCHANGED")
    no_rows = (F.coalesce("rows_a", F.lit(0)) == 0) | (F.coalesce("rows_b", F.lit(0)) == 0)
    return found.select("question", within.alias("answer"), _verdict(
        (no_rows, F.lit("one period is empty")),
        (F.col("groups") == 0, F.lit("no group has rows in both periods")),
        ((within != "IMPROVED") | (overall != "WORSENED"),
         F.concat(F.lit("groups: "), within, F.lit(", whole table: "), overall)),
    ).alias("gap"))


def _shapes(cells: DataFrame) -> DataFrame:
    """Shape scores of (feature, x, y) rows; `feature` is any key."""
    sizes = group_sizes(cells, ["feature"], "x")
    edges = cut(quantiles(cells, ["feature"], "x", [i / _BINS for i in range(_BINS + 1)], sizes)
                .select("feature", F.array_distinct("quantiles").alias("edges"))
                .where(F.size("edges") > 1))
    binned = cells.join(asked_side(edges), "feature").withColumn(
        "bin", bin_of(F.col("x"), F.col("edges"), _BINS))
    means = binned.groupBy("feature", "bin").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"))
    return shape_scores(means.withColumn("outcome", F.lit("y")))


def _peak(asked: _Asked) -> DataFrame:
    cells = asked.joined(
        _column(_slot("OUTCOME_COL")).alias("outcome"),
        _column(F.col("effects.peak_feature")).alias("c"),
    ).select(F.col("question").alias("feature"), number_of(F.col("c")).alias("x"),
             number_of(F.col("outcome")).alias("y")).where(F.col("x").isNotNull())
    found = asked.questions.select(
        "question", F.col("effects.peak_feature").alias("name"),
        F.col("effects.peak_value").alias("value"),
    ).join(_shapes(cells).select(F.col("feature").alias("question"), "peak_inside"),
           "question", "left")
    return found.select(
        "question", F.concat_ws(", ", "name", "value").alias("answer"), _verdict(
            (F.col("name").isNull(), F.lit("missing 'sf_nonmonotone_peak'")),
            (~F.coalesce("peak_inside", F.lit(False)),
             F.concat(F.lit("highest bin of "), "name", F.lit(" is an outer one"))),
        ).alias("gap"))


def _pair(asked: _Asked) -> DataFrame:
    first, second = (F.get(F.array_sort(F.array("effects.feat_a", "effects.feat_b")), F.lit(i))
                     for i in (0, 1))
    rows = asked.joined(
        _column(_slot("OUTCOME_COL")).alias("outcome"), _column(first).alias("c1"),
        _column(second).alias("c2"))
    cells = rows.select("question", number_of(F.col("outcome")).alias("y"),
                        number_of(F.col("c1")).alias("x1"), number_of(F.col("c2")).alias("x2"))
    long = cells.select("question", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("x1").alias("x")),
        F.struct(F.lit(2).alias("side"), F.col("x2").alias("x")))).alias("cell")).select(
        "question", "cell.*").where(F.col("x").isNotNull())
    centre = cut(medians(long, ["question", "side"], "x").groupBy("question").agg(
        F.max(F.when(F.col("side") == 1, F.col("median"))).alias("m1"),
        F.max(F.when(F.col("side") == 2, F.col("median"))).alias("m2")))
    bit1, bit2 = (F.coalesce((F.col(f"x{i}") > F.col(f"m{i}")).cast("int"), F.lit(0))
                  for i in (1, 2))
    means = cells.join(asked_side(centre), "question", "left").select(
        "question", "y", bit1.bitwiseXOR(bit2).alias("bit")).groupBy("question").agg(
        F.avg(F.when(F.col("bit") == 1, F.col("y"))).alias("mean1"),
        F.avg(F.when(F.col("bit") == 0, F.col("y"))).alias("mean0"))
    found = asked.questions.select(
        "question", F.col("effects.feat_a").isNull().alias("absent"),
        F.concat_ws(", ", first, second).alias("answer")).join(means, "question", "left")
    raised = F.coalesce(F.col("mean1") > F.col("mean0"), F.lit(False))
    return found.select("question", "answer", _verdict(
        (F.col("absent"), F.lit("missing 'ix_interaction_dominant'")),
        (~raised, F.lit("the pair's XOR does not raise the outcome"))).alias("gap"))


def _least_monotone(asked: _Asked) -> DataFrame:
    numeric = _features(lambda c: is_number(c) & (c["name"] != _slot("OUTCOME_COL")))
    rows = asked.joined(
        _column(_slot("OUTCOME_COL")).alias("outcome"), numeric.alias("features"),
        _column(F.col("row_key")).alias("key"))
    cells = each_cell(
        rows, "features", "question", number_of(F.col("outcome")).alias("y"),
    ).select("question", "y", "cell.position", "cell.name", number_of(F.col("cell")).alias("x"))
    by = ["question", "position", "name"]
    counts = cut(cells.groupBy(*by, "x").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.count("x").alias("distinct"), F.sum("n").alias("rows")))
    # Columns without repeats that never fall along the row key are ids.
    near = counts.where((F.col("distinct") >= _MIN_UNIQUE) & (F.col("distinct") == F.col("rows")))
    keyed = each_cell(
        rows.where(F.col("key").isNotNull()), "features", "question",
        F.struct(*[F.get(f"_{k}", F.when(F.col("key.kind") == k, F.col("key.at"))).alias(k)
                   for k in "ifdst"]).alias("row"),
    ).select("question", "cell.position", number_of(F.col("cell")).alias("x"), "row").join(
        asked_side(near.select("question", "position")), ["question", "position"], "left_semi")
    total = near.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    group = F.concat_ws(" ", "position", "question")
    ids = falls_along(keyed.select(group.alias("group"), "row", "x"), "group", ["row"], ["x"], total
                      ).where(~F.col("x")).select("group")
    kept = cut(counts.where(F.col("distinct") >= _MIN_UNIQUE).withColumn("group", group).join(
        ids, "group", "left_anti").select(*by))
    usable = cells.where(F.col("x").isNotNull()).join(asked_side(kept), by, "left_semi")
    scores = _shapes(usable.select(F.struct("question", "position").alias("feature"), "x", "y"))
    rho = kept.join(scores.select("feature.*", F.abs("rho").alias("rho")),
                    ["question", "position"], "left")
    lowest = rho.groupBy("question").agg(F.min_by(
        "name", F.struct(F.coalesce("rho", F.lit(1.0)), "position")).alias("lowest"))
    found = asked.questions.select(
        "question", F.col("effects.injected_feature").alias("truth")).join(lowest, "question", "left")
    return found.select("question", F.col("truth").alias("answer"), _verdict(
        (F.col("truth").isNull(), F.lit("missing 'sf_monotone_classify'")),
        (~F.col("lowest").eqNullSafe(F.col("truth")),
         F.concat(F.coalesce("lowest", F.lit("None")), F.lit(" is less monotone than "), "truth")),
    ).alias("gap"))


_KINDS: dict[str, tuple[Callable[[_Asked], DataFrame], list[str], list[str]]] = {
    # What computes an answer, the slots it needs, and the injectors whose effects it needs.
    "top_by_correlation": (_by_correlation, ["OUTCOME_COL"], []),
    "top_by_auroc": (_by_auroc, ["OUTCOME_COL"], []),
    "bad_row_column": (_bad_rows, [], ["dq_bad_row_indicator", "dq_bad_row_indicator_v1"]),
    "riskier_group": (_riskier_group, ["GROUP_COL", "RISK_METRIC_COL", "GROUP_A", "GROUP_B"],
                      ["dq_riskier_group"]),
    "retrain_point": (_retrain_point, [], ["rca_retrain_point"]),
    "performance_improved": (
        _performance, ["GROUP_COL", "TIME_COL", "SPECIFIC_DATE", "OUTCOME_COL"],
        ["rca_performance_improve"]),
    "peak_feature": (_peak, ["OUTCOME_COL"], ["sf_nonmonotone_peak"]),
    "dominant_pair": (_pair, ["OUTCOME_COL"], ["ix_interaction_dominant"]),
    "least_monotone": (_least_monotone, ["OUTCOME_COL"], ["sf_monotone_classify"]),
}
_KIND_OF = {template: compute.__name__ for template, compute in ANSWERS.items()}


def answer_questions(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Answers with their status: (instance, template_id, answer, status, reason).

    `questions` has instance, template_id, injector, slots (map), effects (JSON text), columns
    (records) and row_key; `rows` what :func:`tabprobe.sources.stacked.read_places` gives for all
    instances, and the instance of each row. Status and reason are those of
    :func:`tabprobe.operators.answers.answer_safe`; a slot that names no column of the table is an
    error. The number of jobs depends on the kinds of questions, not on how many there are.
    """
    kind = F.create_map(*[F.lit(x) for pair in _KIND_OF.items() for x in pair])
    listed = cut(questions.select(
        F.concat_ws(" ", "instance", "template_id").alias("question"), "instance", "template_id",
        "injector", "slots", F.from_json("effects", EFFECTS).alias("effects"), "columns", "row_key",
        kind[F.col("template_id")].alias("kind")))
    def of_kind(place: int) -> Column:
        return F.create_map(*[x for name, entry in _KINDS.items() for x in (
            F.lit(name), F.array(*[F.lit(v) for v in entry[place]]).cast("array<string>"))
        ])[F.col("kind")]

    needed, own = of_kind(1), of_kind(2)
    open_slot = F.get(F.filter(needed, lambda s: F.element_at("slots", s).isNull()), F.lit(0))
    names = F.transform("columns", lambda c: c["name"])
    stray = F.get(F.filter(needed, lambda s: s.endswith("_COL") & ~F.array_contains(
        names, F.element_at("slots", s))), F.lit(0))
    absent = (F.size(own) > 0) & ~F.array_contains(own, F.col("injector"))
    checked = cut(listed.withColumn("wrong", _verdict(
        (open_slot.isNotNull(), F.concat(F.lit("missing '"), open_slot, F.lit("'"))),
        (stray.isNotNull(), F.concat(F.lit("no column "), F.element_at("slots", stray))),
        (absent, F.concat(F.lit("missing '"), F.get(own, F.lit(0)), F.lit("'"))))))
    asked = checked.where(F.col("kind").isNotNull() & F.col("wrong").isNull())
    found = []
    for r in asked.groupBy("kind").agg(F.count("*").alias("n"),
                                       F.collect_set("injector").alias("of")).collect():
        own = asked.where(F.col("kind") == r["kind"])
        of = rows.where(F.col("injector").isin(r["of"]))  # reads the folders of these only
        found.append(_KINDS[r["kind"]][0](_Asked(own, of, r["n"] <= MOST_SENT)))
    answers = reduce(DataFrame.unionByName, found) if found else checked.limit(0).select(
        "question", F.lit("").alias("answer"), F.lit("").alias("gap"))
    table = checked.join(answers, "question", "left")
    reason = F.when(F.col("kind").isNull(), "no answer for this template").otherwise(
        F.coalesce("wrong", "gap", F.lit("")))
    status = F.when(F.col("kind").isNull(), "SKIP").when(reason == "", "OK").otherwise("ERROR")
    return table.select(
        "instance", "template_id", F.when(status == "OK", F.col("answer")).alias("answer"),
        status.alias("status"), reason.alias("reason"))
