"""Mixing of sources to target weights by hierarchical budgets.

A budget of tokens goes down a tree of domains, languages and sources by their weights. A node
never gets more than its sources can give; what it cannot take goes to its siblings first and
further up only when all of them are full. Each source then gives whole seeded epochs and a
token-prefix of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import stored

LEVELS = ("domain", "language", "branch")
#: Leading hex digits of the order's digest: epochs are summed up in so many steps per source.
DIGITS = 3
NOTHING = "none"


def word_counts(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the number of words between ASCII white space in place of text (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n = [len(t.split()) if t else 0 for t in texts]
            rest = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())],
                                             names=[*names, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kinds, f"{name} long"]))


def _weight(weights: Mapping[tuple[str, ...], float], depth: int) -> Column:
    """Weight of a node by its path; 1 where none is given."""
    out = F.lit(1.0)
    for path, weight in sorted(weights.items()):
        if len(path) == depth:
            here = F.lit(True)
            for level, name in zip(LEVELS, path):
                here = here & (F.col(level) == name)
            out = F.when(here, F.lit(float(weight))).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: float, weights: Mapping[tuple[str, ...], float],
            epochs: int) -> DataFrame:
    """Budget in tokens of each leaf (domain, language, branch, tokens).

    Of siblings with weights w and room c (their tokens times `epochs`) that share a budget b, each
    gets min(c, w x), with the x for which this sums up to b. Sorted by c / w it is the largest
    (b - room of those before) / (weight of the others). Weights must not be negative; siblings
    of weight 0 get nothing, and what lies below them is no room of the nodes above.
    """
    takes = F.lit(True)
    for depth in range(1, len(LEVELS) + 1):
        takes = takes & (_weight(weights, depth) > 0)
    nodes = leaves.withColumn("room", F.when(takes, F.col("tokens").cast("double") * epochs)
                              .otherwise(0.0))
    nodes = nodes.withColumn("budget", F.lit(float(total)))
    for depth in range(1, len(LEVELS) + 1):
        path, above = list(LEVELS[:depth]), list(LEVELS[:depth - 1])
        level = nodes.groupBy(*path).agg(
            F.sum("room").alias("room"), F.max("budget").alias("given")
        ).withColumn("weight", _weight(weights, depth))
        ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight"))
        family = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = family.orderBy(F.asc_nulls_last("ratio"), path[-1])
        level = level.withColumn("ratio", ratio).withColumn(
            "before", F.coalesce(F.sum("room").over(order.rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0.0))
        ).withColumn("others", F.sum("weight").over(order.rowsBetween(
            0, Window.unboundedFollowing)))
        x = F.when(F.col("others") > 0, (F.col("given") - F.col("before")) / F.col("others"))
        level = level.withColumn("x", F.coalesce(F.max(x).over(family), F.lit(0.0)))
        level = level.select(*path, F.greatest(F.lit(0.0), F.least(
            "room", F.col("weight") * F.col("x"))).alias("budget"))
        nodes = nodes.drop("budget").join(level, path)
    return nodes.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).alias("budget"))


def mixed(docs: DataFrame, domain: Column, total: float | None = None, share: float = 1.0,
          weights: Mapping[tuple[str, ...], float] | None = None, epochs: int = 2,
          seed: int = 17) -> DataFrame:
    """How often each document is taken: doc_id, domain, language, branch, tokens, copies.

    `domain`: column over `docs`; language and branch are lang and source. Null names are one
    group, `none`. Tokens are words between ASCII white space (null text: 0). The budget is `total`
    tokens, or `share` of all there are. `weights` maps paths (domain,), (domain, language) and
    (domain, language, source) to weights; others weigh 1. A leaf with budget b and t tokens is
    taken b // t times whole (at most `epochs`); of the next epoch those documents are taken whose
    tokens, summed up in the order of md5(seed:epoch:doc_id), still fit into the rest. Documents
    without tokens are taken with whole epochs and where the prefix reaches them. Rows that repeat
    a doc_id are taken or left together if the prefix holds all of them, else in no given order.
    Leaves without tokens have no budget; their documents are taken once.

    A leaf may hold any share of all documents: its epoch is summed up by the leading digits of
    the digests, and only the one step in which the prefix ends is sorted.
    """
    named = docs.select(
        "doc_id", "text", F.coalesce(domain.cast("string"), F.lit(NOTHING)).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NOTHING)).alias("language"),
        F.coalesce(F.col("source").cast("string"), F.lit(NOTHING)).alias("branch"))
    counted = stored(word_counts(named, "tokens"), "token-counts")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    if total is None:
        total = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    plan = budgets(leaves, total, weights or {}, epochs).select(
        *LEVELS, F.col("tokens").alias("supply"), "budget"
    ).withColumn("whole", F.when(F.col("supply") > 0, F.least(
        F.floor(F.col("budget") / F.greatest("supply", F.lit(1))), F.lit(epochs))).otherwise(1)
    ).withColumn("rest", F.when(F.col("whole") >= epochs, 0).otherwise(
        F.col("budget") - F.col("whole") * F.col("supply")))
    plan = stored(plan, "budgets")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"),
                               F.coalesce(F.col("doc_id").cast("string"), F.lit(NOTHING))))
    rows = counted.join(plan, list(LEVELS)).withColumn("digest", digest).withColumn(
        "step", F.substring("digest", 1, DIGITS))
    sums = rows.groupBy(*LEVELS, "step").agg(
        F.sum("tokens").alias("n"), F.first("rest").alias("limit"))
    run = Window.partitionBy(*LEVELS).orderBy("step")
    sums = sums.withColumn("reached", F.sum("n").over(run)).select(
        *LEVELS, "step", (F.col("reached") - F.col("n")).alias("base"), "reached")
    rows = rows.join(sums, [*LEVELS, "step"])
    whole = F.col("whole").cast("long")
    inside = rows.filter("base > rest or reached <= rest").withColumn(
        "copies", whole + F.when(F.col("reached") <= F.col("rest"), 1).otherwise(0))
    inside = inside.withColumn("copies", F.when(F.col("rest") > 0, F.col("copies"))
                               .otherwise(whole))
    place = Window.partitionBy(*LEVELS, "step").orderBy("digest")
    border = rows.filter("base <= rest and reached > rest").withColumn(
        "sum", F.col("base") + F.sum("tokens").over(
            place.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("copies", whole + F.when(
        (F.col("sum") <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)).drop("sum")
    return inside.unionByName(border).select("doc_id", *LEVELS, "tokens", "copies")
