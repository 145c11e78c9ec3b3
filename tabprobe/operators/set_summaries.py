"""Summaries of the tables of many instances at once.

The same figures as :mod:`tabprobe.operators.summaries` gives for one table, each part as one
aggregate over (instance, ...), from rows under their places (:mod:`tabprobe.sources.stacked`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.operators.pairs import pair_cells
from tabprobe.operators.ranks import group_sizes, quantiles
from tabprobe.operators.set_answers import asked_side
from tabprobe.operators.shapes import bin_of
from tabprobe.operators.summaries import _Z95, EVEN, cell_effects, ranked_lines
from tabprobe.sources.shared import cut
from tabprobe.sources.stacked import each_cell, is_number, number_of, text_of


def _placed(keep) -> Column:
    """Records of the features that `keep` accepts, with their place among all columns."""
    placed = F.transform("columns", lambda c, i: F.struct(
        c["name"].alias("name"), c["type"].alias("type"), c["kind"].alias("kind"),
        c["at"].alias("at"), i.alias("position")))
    return F.filter(placed, lambda c: (c["name"] != F.col("target")) & keep(c))


def _target() -> Column:
    return F.get(F.filter("columns", lambda c: c["name"] == F.col("target")), F.lit(0))


def overviews(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """instance, target, n_rows, n_features, features."""
    names = F.transform(F.filter("columns", lambda c: c["name"] != F.col("target")),
                        lambda c: c["name"])
    counts = rows.join(asked_side(instances.select("instance")), "instance", "left_semi").groupBy(
        "instance").agg(F.count("*").alias("n_rows"))
    return instances.join(counts, "instance", "left").select(
        "instance", "target", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.size(names).alias("n_features"), names.alias("features"))


def summaries_of(rows: DataFrame, instances: DataFrame, q: int = 5) -> dict[str, DataFrame]:
    """Overview, shapes, importance, features and interactions of all of `instances`.

    `instances` has instance, target (the name of a column) and columns; `rows` the rows of their
    tables. Results have the columns of the single-table summaries and the instance.
    """
    plan = cut(instances.select(
        "instance", "target", "columns", _target().alias("outcome"),
        _placed(lambda c: F.lit(True)).alias("features"), _placed(is_number).alias("numbers")))
    own = rows.join(asked_side(plan), "instance")
    y = number_of(F.col("outcome"))
    c = F.col("cell")
    cells = each_cell(own, "features", "instance", y.alias("y")).select(
        "instance", "y", "cell.position", c["name"].alias("feature"), "cell.kind",
        is_number(c).alias("numeric"), number_of(c).alias("x"), text_of(c).alias("label"))
    by = ["instance", "feature"]

    numeric = cells.where(F.col("numeric") & F.col("x").isNotNull())
    sizes = group_sizes(numeric, by, "x")
    edges = cut(quantiles(numeric, by, "x", [i / q for i in range(q + 1)], sizes).select(
        *by, F.array_distinct("quantiles").alias("edges")).where(F.size("edges") > 1))
    aggregates = [
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("spread")]
    bins = numeric.join(asked_side(edges), by).withColumn(
        "bin", bin_of(F.col("x"), F.col("edges"), q)).groupBy(*by, "bin").agg(*aggregates).join(
        edges, by).select(
        *by, F.lit("continuous").alias("type"), "bin", F.lit(None).cast("string").alias("label"),
        F.element_at("edges", F.col("bin")).alias("lo"),
        F.element_at("edges", F.col("bin") + 1).alias("hi"), "n", "mean", "spread")
    named = cells.where(~F.col("numeric") & F.col("label").isNotNull()).groupBy(
        *by, "label").agg(*aggregates).select(
        *by, F.lit("categorical").alias("type"), F.lit(None).cast("int").alias("bin"), "label",
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        "n", "mean", "spread")
    overall = own.groupBy("instance").agg(F.avg(y).alias("overall"))
    score = F.col("mean") - F.col("overall")
    std = F.coalesce(F.try_divide(F.col("spread"), F.sqrt("n")), F.lit(0.0))
    shapes = cut(bins.unionByName(named).where(F.col("n") > 0).join(overall, "instance").select(
        *by, "type", "bin", "label", "lo", "hi", "n", score.alias("score"), std.alias("std"),
        (score - F.lit(_Z95) * std).alias("lower"), (score + F.lit(_Z95) * std).alias("upper")))
    importance = shapes.groupBy(*by).agg(
        (F.sum(F.abs("score") * F.col("n")) / F.sum("n")).alias("importance"))
    return {
        "overview": overviews(rows, plan), "shapes": shapes, "importance": importance,
        "features": _features(cells, plan, importance),
        "interactions": _interactions(own, plan, edges, y, q),
    }


def _features(cells: DataFrame, plan: DataFrame, importance: DataFrame) -> DataFrame:
    """Features of every instance by importance, with their statistics and a line of text."""
    by = ["instance", "position"]
    number = F.when(F.col("numeric"), F.col("x"))
    seen = F.when(F.col("kind") == "f", F.col("x").cast("string")).otherwise(F.col("label"))
    stats = cells.groupBy(*by).agg(
        F.count_if(seen.isNull()).alias("n_missing"), F.min(number).alias("min_value"),
        F.max(number).alias("max_value"), F.round(F.avg(number), 4).alias("mean"),
        F.round(F.stddev_samp(number), 4).alias("std"))
    counts = cells.select(*by, seen.alias("seen")).where(F.col("seen").isNotNull()).groupBy(
        *by, "seen").agg(F.lit(1).alias("_")).groupBy(*by).agg(F.count("*").alias("n_unique"))
    listed = plan.select("instance", F.explode("features").alias("c")).select(
        "instance", "c.position", F.col("c.name").alias("feature"), F.col("c.type").alias("dtype"))
    scored = listed.join(stats, by, "left").join(counts, by, "left").join(
        importance, ["instance", "feature"], "left")
    return ranked_lines(scored.select(
        "instance", "feature", "position", "dtype",
        F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"),
        F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"), "min_value",
        "max_value", "mean", "std", F.coalesce("importance", F.lit(0.0)).alias("importance"),
    ), ["instance"])


def _interactions(
    own: DataFrame, plan: DataFrame, edges: DataFrame, y: Column, q: int
) -> DataFrame:
    """Pairs of numeric features of every instance by the strength of their interaction."""
    numbers = plan.select("instance", F.explode("numbers").alias("c")).select(
        "instance", "c.*").join(edges.withColumnRenamed("feature", "name"), ["instance", "name"])
    binned = cut(numbers.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct(
        "position", "name", "type", "kind", "at", "edges"))).alias("binned")))
    # Numbers first: each is read once, however many edges it is compared with.
    numbered = F.transform("binned", lambda c: F.struct(
        number_of(c).alias("x"), c["edges"].alias("edges")))
    bins = F.transform(numbered, lambda c: F.when(
        c["x"].isNotNull(), bin_of(c["x"], c["edges"], q)))
    rows = own.join(asked_side(binned), "instance").select(
        "instance", bins.alias("bins"), y.alias("y"))
    cells = cell_effects(pair_cells(rows, "instance", "bins", "y", q), ["instance", "a", "b"])
    scored = cells.groupBy("instance", "a", "b").agg(
        (F.sum(F.abs("extra") * F.col("n")) / F.sum("n")).alias("importance"))
    order = Window.partitionBy("instance").orderBy(
        F.desc(F.round("importance", EVEN)), "feat_a", "feat_b")
    return scored.join(binned, "instance").select(
        "instance", F.get("binned.name", F.col("a")).alias("feat_a"),
        F.get("binned.name", F.col("b")).alias("feat_b"), "importance",
    ).withColumn("rank", F.row_number().over(order))
