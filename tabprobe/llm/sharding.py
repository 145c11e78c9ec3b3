"""Shards of exact sizes by a uniform shuffle of all rows.

The shuffle follows its communication matrix: how many rows of each partition go to each shard is
drawn first, from the distribution that a uniformly random permutation has (multivariate
hypergeometric, rows summing to the partitions and columns to the shards). Every partition is then
permuted where it lies and cut into runs of those lengths, the runs are exchanged, and every shard
is permuted again. All of it, the draws included, is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import partitions_of, stored

#: Rows of a shard that one task orders (about).
PART_ROWS = 200_000
#: Cells of the communication matrix that are broadcast at most (8 bytes each).
MOST_CELLS = 1_000_000
#: Deviations from the mode within which a draw is looked for; beyond lies less than 2^-53.
REACH = 9.0
#: Splits of the matrix that one task does before they are dealt to others.
SPLITS_AT_ONCE = 8


def _bound(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows are marked ones, of which there are `marked` among `total`.

    Inversion of the distribution at `u` (0 to 1), beginning at its mode: weights relative to that
    of the mode follow from one another, outwards on both sides, and are summed up in the same
    order twice, for their total and for the place where `u` lies.
    """
    given = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("m"),
                     drawn.cast("double").alias("k"), u.alias("u"))

    def limits(g: Column) -> Column:
        n, m, k = g["n"], g["m"], g["k"]
        low, high = F.greatest(F.lit(0.0), k + m - n), F.least(k, m)
        spread = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(
            k * m * (n - m) * (n - k), n * n * (n - 1)), F.lit(0.0))))
        mode = F.floor((k + 1) * (m + 1) / (n + 2)).cast("double")
        return F.struct(
            n, m, k, g["u"].alias("u"), (n - m - k).alias("others"), low.alias("low"),
            high.alias("high"), F.greatest(F.least(mode, high), low).alias("mode"),
            F.least(F.ceil(spread * REACH) + 10, (high - low).cast("long")).alias("steps"))

    def drawn_from(g: Column) -> Column:
        mode, m, k, others = g["mode"], g["m"], g["k"], g["others"]

        def above(x: Column, w: Column) -> Column:
            """Weight of x + 1 from that of x."""
            return F.when(x >= g["high"], F.lit(0.0)).otherwise(
                w * ((m - x) / (x + 1)) * ((k - x) / (others + x + 1)))

        def below(x: Column, w: Column) -> Column:
            """Weight of x - 1 from that of x."""
            return F.when(x <= g["low"], F.lit(0.0)).otherwise(
                w * (x / (m - x + 1)) * ((others + x) / (k - x + 1)))

        def add(state: Column, i: Column) -> Column:
            return F.struct(
                above(mode + i, state["up"]).alias("up"),
                below(mode - i, state["down"]).alias("down"),
                (state["sum"] + state["up"] + F.when(i > 0, state["down"]).otherwise(0.0))
                .alias("sum"))

        def find(state: Column, i: Column) -> Column:
            lower = F.when(i > 0, state["down"]).otherwise(0.0)
            first = state["left"] - state["up"]
            return F.when(state["found"].isNotNull(), state).otherwise(F.struct(
                above(mode + i, state["up"]).alias("up"),
                below(mode - i, state["down"]).alias("down"), (first - lower).alias("left"),
                F.when(first <= 0, mode + i).when(first - lower <= 0, mode - i).alias("found")))

        places = F.sequence(F.lit(0).cast("long"), g["steps"])
        both = F.lit(1.0).alias("up"), F.lit(1.0).alias("down")
        whole = F.aggregate(places, F.struct(*both, F.lit(0.0).alias("sum")), add,
                            lambda s: s["sum"])
        seek = F.struct(*both, (g["u"] * whole).alias("left"),
                        F.lit(None).cast("double").alias("found"))
        return F.coalesce(F.aggregate(places, seek, find, lambda s: s["found"]), mode).cast("long")

    return _bound(_bound(given, limits), drawn_from)


def uniform(seed: int, *keys: Column) -> Column:
    """A number between 0 and 1, neither of them, from the hash of the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12).cast("double")
    return (bits + 0.5) * (2.0 ** -52)


def split(of_shard: Column, drawn: Column, seed: int, node: Column) -> Column:
    """Counts by shard of the first `drawn` rows of a shuffle of rows with the given counts."""
    total = F.aggregate(of_shard, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("total"), drawn.cast("long").alias("drawn"),
                     F.array().cast("array<long>").alias("of"))

    def deal(state: Column, marked: Column) -> Column:
        chosen = hypergeometric(state["total"], marked, state["drawn"],
                                uniform(seed, node, F.size(state["of"])))
        return _bound(chosen, lambda c: F.struct(
            (state["total"] - marked).alias("total"), (state["drawn"] - c).alias("drawn"),
            F.array_append(state["of"], c).alias("of")))

    return F.aggregate(of_shard, start, deal, lambda s: s["of"])


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per partition, how many of its rows go to each shard: part and of_shard (array of longs).

    `counts` has part and n, one row per partition; its rows are summed up to one of totals, which
    is halved again and again: the rows of a half are a sample without replacement of its parent's.
    The halves of one level are independent of each other and dealt over tasks.
    """
    listed = counts.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    number = F.sequence(F.lit(0), F.lit(shards - 1))
    nodes = listed.filter(F.size("parts") > 0).select(
        F.lit(1).cast("long").alias("node"), "parts",
        F.transform(number, lambda s: F.floor((total + shards - 1 - s) / shards).cast("long"))
        .alias("of_shard"))
    half = F.floor(F.size("parts") / 2).cast("int")
    levels = math.ceil(math.log2(max(counts.count(), 1)))
    for level in range(levels):
        if level and 1 << level == SPLITS_AT_ONCE:
            nodes = nodes.repartition(partitions_of(counts.sparkSession), "node")
        left = F.slice("parts", F.lit(1), half)
        rows = F.aggregate(left, F.lit(0).cast("long"), lambda a, p: a + p["n"])
        halved = nodes.withColumn("left", F.when(
            half > 0, split(F.col("of_shard"), rows, seed, F.col("node"))))
        rest = F.zip_with("of_shard", "left", lambda a, b: a - b)
        nodes = halved.select(F.explode(F.when(half > 0, F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("parts"),
                     F.col("left").alias("of_shard")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.slice("parts", half + 1, F.size("parts") - half).alias("parts"),
                     rest.alias("of_shard")),
        )).otherwise(F.array(F.struct(
            (F.col("node") * 2).alias("node"), "parts", "of_shard")))).alias("one")).select("one.*")
    return nodes.select(F.col("parts")[0]["part"].alias("part"), "of_shard")


def sharded(docs: DataFrame, shards: int = 24, seed: int = 12, part_rows: int = PART_ROWS,
            most_cells: int = MOST_CELLS) -> DataFrame:
    """`docs` with the shard (from 0) and the slot in it (from 0, without gaps) of every row.

    The number of rows of two shards differs by one at most; each shard is a uniform sample of
    all rows, in uniform order. All columns of `docs` stay, whatever their names and values, but
    `shard` and `slot`, which are replaced; null ids, empty texts and repeated rows are rows like
    others. Fewer rows than shards leave shards empty; no rows give none. The result depends on
    `seed` and on how the table is partitioned.

    Rows are written once to the shared folder in the order of their partitions' permutations, so
    that a partition's counts hold whatever is run again later. A partition is one of the input's:
    no key decides where a row lies, so none can be hot. A shard is ordered in parts of about
    `part_rows` rows by the leading bits of a hash of the row's place. The matrix is broadcast up
    to `most_cells` cells, else joined by partition.
    """
    own = docs.drop("shard", "slot")
    names = [f"c{i}" for i in range(len(own.columns))]
    row = F.monotonically_increasing_id()
    shuffled = own.toDF(*names).withColumn("h", F.xxhash64(F.lit(seed), row)) \
        .sortWithinPartitions("h").select(*names, row.alias("at"))
    rows = stored(shuffled, "permuted").withColumn("part", F.shiftright("at", 33)).withColumn(
        "place", F.col("at").bitwiseAND((1 << 33) - 1))
    counts = stored(rows.groupBy("part").agg(F.count("*").alias("n")), "partition-counts")
    size = counts.agg(F.count("*").alias("parts"), F.sum("n").alias("rows")).first()
    if not size.parts:
        return rows.select(*[F.col(n).alias(c) for n, c in zip(names, own.columns)],
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    matrix = stored(communication_matrix(counts, shards, seed), "communication")
    upto = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("of_shard", F.lit(1), s), F.lit(0).cast("long"),
                              lambda a, x: a + x))
    matrix = matrix.select("part", upto.alias("upto"))
    if size.parts * shards <= most_cells:
        matrix = F.broadcast(matrix)
    pieces = max(1, -(-size.rows // (shards * part_rows)))
    again = F.xxhash64(F.lit(seed + 1), "at")
    dealt = rows.join(matrix, "part").withColumn(
        "shard", F.size(F.filter("upto", lambda x: x <= F.col("place"))).cast("int")
    ).withColumn("again", again).withColumn(
        "piece", F.floor(uniform(seed + 1, F.col("at")) * pieces).cast("int"))
    sizes = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n")).withColumn(
        "first", F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    ).drop("n")
    order = Window.partitionBy("shard", "piece").orderBy("again", "at")
    placed = dealt.withColumn("in_piece", F.row_number().over(order)).join(
        stored(sizes, "shard-pieces"), ["shard", "piece"])
    return placed.select(
        *[F.col(n).alias(c) for n, c in zip(names, own.columns)], "shard",
        (F.col("first") + F.col("in_piece") - 1).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """The rows of :func:`sharded` as one folder per shard, in the order of their slots."""
    parts = partitions_of(rows.sparkSession)
    rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
