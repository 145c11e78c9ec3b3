"""What a table says about its outcome: shape functions, importances, interactions, overview."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.numbers import is_number, to_double
from tabprobe.operators.moments import column_stats, top_values
from tabprobe.operators.pairs import pair_cells
from tabprobe.operators.shapes import assign_bins, bin_of, quantile_edges

_Z95 = 1.96
#: Importances that agree to so many places are ranked alike.
EVEN = 12


def shape_function(
    df: DataFrame, outcome: str, features: list[str] | None = None, q: int = 5, **sizing
) -> DataFrame:
    """Per feature and bin (or category): mean outcome minus the overall mean, with its band.

    Columns: ``feature, type, bin, label, lo, hi, n, score, std, lower, upper``; ``std`` is the
    standard error of the bin mean.
    """
    names = features or [c for c in df.columns if c != outcome]
    numeric = [n for n in names if is_number(df.schema[n].dataType)]
    named = [n for n in names if n not in numeric]
    y = to_double(df, outcome)
    aggregates = [
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("spread")
    ]
    pieces = []
    if numeric:
        edges = quantile_edges(df, numeric, q, **sizing)
        binned = assign_bins(df, numeric, edges, {"y": y}, q)
        pieces.append(
            binned.groupBy("feature", "bin").agg(*aggregates)
            .join(F.broadcast(edges), "feature")
            .select(
                "feature", F.lit("continuous").alias("type"), "bin",
                F.lit(None).cast("string").alias("label"),
                F.element_at("edges", F.col("bin")).alias("lo"),
                F.element_at("edges", F.col("bin") + 1).alias("hi"), "n", "mean", "spread",
            )
        )
    if named:
        long = df.select(y.alias("y"), *[F.col(n).cast("string").alias(n) for n in named]).unpivot(
            ["y"], named, "feature", "label"
        ).where(F.col("label").isNotNull())
        pieces.append(
            long.groupBy("feature", "label").agg(*aggregates).select(
                "feature", F.lit("categorical").alias("type"), F.lit(None).cast("int").alias("bin"),
                "label", F.lit(None).cast("double").alias("lo"),
                F.lit(None).cast("double").alias("hi"), "n", "mean", "spread",
            )
        )
    table = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    overall = df.agg(F.avg(y).alias("overall"))
    score = F.col("mean") - F.col("overall")
    std = F.coalesce(F.try_divide(F.col("spread"), F.sqrt("n")), F.lit(0.0))
    return table.where(F.col("n") > 0).crossJoin(F.broadcast(overall)).select(
        "feature", "type", "bin", "label", "lo", "hi", "n",
        score.alias("score"), std.alias("std"),
        (score - F.lit(_Z95) * std).alias("lower"), (score + F.lit(_Z95) * std).alias("upper"),
    )


def importance(shapes: DataFrame) -> DataFrame:
    """Per feature: mean absolute score, weighted by rows."""
    return shapes.groupBy("feature").agg(
        (F.sum(F.abs("score") * F.col("n")) / F.sum("n")).alias("importance")
    )


def interaction_surface(
    df: DataFrame, outcome: str, pairs: list[tuple[str, str]], q: int = 5, **sizing
) -> DataFrame:
    """Per pair of binned features and cell: what the mean outcome adds to the two main effects.

    One scan sums up all pairs of the named features at once, see :mod:`tabprobe.operators.pairs`.
    """
    names = list(dict.fromkeys(n for pair in pairs for n in pair))
    edges = {r["feature"]: r["edges"] for r in quantile_edges(df, names, q, **sizing).collect()}
    names = [n for n in names if len(edges.get(n) or ()) > 1]
    bins = [
        F.when(to_double(df, n).isNotNull(),
               bin_of(to_double(df, n), F.array(*[F.lit(e) for e in edges[n]]), q))
        for n in names
    ]
    rows = df.select(
        F.lit(0).alias("all"), F.array(*bins).cast("array<int>").alias("bins"),
        to_double(df, outcome).alias("y"))
    at = {n: i for i, n in enumerate(names)}
    wanted = df.sparkSession.createDataFrame(
        [(min(at[a], at[b]), max(at[a], at[b]), a, b) for a, b in pairs if a in at and b in at],
        "a int, b int, feat_a string, feat_b string")
    cells = pair_cells(rows, "all", "bins", "y", q).join(wanted, ["a", "b"])
    turned = F.col("feat_a") != F.get(
        F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("a"))
    return cell_effects(cells.withColumns({
        "bin_a": F.when(turned, F.col("bin_b")).otherwise(F.col("bin_a")),
        "bin_b": F.when(turned, F.col("bin_a")).otherwise(F.col("bin_b")),
    }), ["feat_a", "feat_b"]).select("feat_a", "feat_b", "bin_a", "bin_b", "n", "extra")


def cell_effects(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by..., bin_a, bin_b, n, total) with ``extra``: their mean less both main effects.

    A pair has at most q x q cells.
    """
    def mean_over(*within: str) -> Column:
        window = Window.partitionBy(*by, *within)
        return F.sum("total").over(window) / F.sum("n").over(window)

    extra = F.col("total") / F.col("n") - mean_over("bin_a") - mean_over("bin_b") + mean_over()
    return cells.withColumn("extra", extra)


def interaction_importance(surface: DataFrame) -> DataFrame:
    """Per pair: mean absolute cell effect, weighted by rows, strongest first in ``rank``."""
    scored = surface.groupBy("feat_a", "feat_b").agg(
        (F.sum(F.abs("extra") * F.col("n")) / F.sum("n")).alias("importance")
    )
    order = Window.orderBy(
        F.desc(F.round("importance", EVEN)), "feat_a", "feat_b")  # one row per column pair
    return scored.withColumn("rank", F.row_number().over(order))


def interactions_of(df: DataFrame, outcome: str, features: list[str], q: int = 5, **sizing):
    return interaction_importance(
        interaction_surface(df, outcome, list(combinations(features, 2)), q, **sizing)
    )


def find_pair(interactions: DataFrame, first: str, second: str) -> DataFrame:
    """The importance of a pair in either order, and all pairs there are, the strongest first."""
    pair = F.concat_ws(" & ", "feat_a", "feat_b")
    hit = (
        ((F.col("feat_a") == first) & (F.col("feat_b") == second))
        | ((F.col("feat_a") == second) & (F.col("feat_b") == first))
    )
    shown = F.array_sort(F.collect_list(F.struct("rank", pair.alias("pair"))))
    return interactions.agg(
        F.max(F.when(hit, F.col("importance"))).alias("importance"),
        F.count("*").alias("pairs"), shown["pair"].alias("available"),
    ).withColumn("found", F.col("importance").isNotNull())


def feature_summary(
    df: DataFrame, outcome: str, shapes: DataFrame | None = None, **sizing
) -> DataFrame:
    """Features by importance with range, mean and distinct count, and a line of text each."""
    features = [c for c in df.columns if c != outcome]
    shapes = shape_function(df, outcome, features, **sizing) if shapes is None else shapes
    stats = column_stats(df).where(F.col("feature") != outcome)
    scored = stats.join(F.broadcast(importance(shapes)), "feature", "left").withColumn(
        "importance", F.coalesce("importance", F.lit(0.0))
    )
    return ranked_lines(scored, [])


def ranked_lines(scored: DataFrame, by: list[str]) -> DataFrame:
    """Scored columns with their rank in each table (or in the only one) and a line of text."""
    window = Window.partitionBy(*by) if by else Window
    order = window.orderBy(F.desc("importance"), "position")  # one row per column
    described = F.concat_ws(
        ", ",
        F.when(F.col("min_value").isNotNull(),
               F.format_string("Range %s–%s", F.col("min_value").cast("string"),
                               F.col("max_value").cast("string"))),
        F.when(F.col("mean").isNotNull(), F.concat(F.lit("mean "), F.col("mean").cast("string"))),
        F.format_string("%d unique values", "n_unique"),
    )
    return scored.withColumn("rank", F.row_number().over(order)).withColumn(
        "line",
        F.format_string("%d. %s (%.3f). %s.", "rank", "feature", "importance", described),
    )


def named_top_values(df: DataFrame, outcome: str, k: int = 5) -> DataFrame:
    """Per non-numeric feature: its most frequent values with their counts, as a map."""
    named = [
        f.name for f in df.schema.fields if f.name != outcome and not is_number(f.dataType)
    ]
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "n")))
    return top_values(df, named, k).groupBy("feature").agg(listed.alias("l")).select(
        "feature", F.map_from_arrays("l.value", "l.n").alias("top_values")
    )


def overview(df: DataFrame, outcome: str) -> DataFrame:
    features = [c for c in df.columns if c != outcome]
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(outcome).alias("target"), "n_rows", F.lit(len(features)).alias("n_features"),
        F.array(*[F.lit(c) for c in features]).alias("features"),
    )

