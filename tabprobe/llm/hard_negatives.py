"""Hard negatives for anchors, from exact integer products of anchor and candidate tiles.

Scores are products of whole numbers, multiplied tile by tile with Strassen's recursion. A first
round over all tiles keeps, for each anchor, the best candidates of its own label; their scores set
the windows in which a second round keeps the best candidates of other labels. What is kept for a
tile and what is kept for all candidates so far merge into what is kept for both, so tiles can be
compared in any order and on any machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import partitions_of, stored
from tabprobe.llm.vectors import finite

#: Whole-number components beyond this count as this, so that scores fit into 64 bits.
MOST = 1 << 24
#: Anchors and candidates of a group that one task compares, at most (about).
ANCHORS, CANDIDATES = 16_384, 65_536
#: Candidates below which a group is not split for more parallel work.
LEAST_CANDIDATES = 2_048
#: Rows of a product that is multiplied at once, and its columns.
TILE_ROWS, TILE_COLUMNS = 256, 4_096
#: Side of a tile from which on it is multiplied outright.
LEAF = 32
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, by seven products of halves instead of eight.

    Sides are padded with zeros to even numbers at every level. Sums and differences are exact
    modulo 2^64, and so is the result, whatever intermediate values are.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    half_m, half_k, half_n = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    a11, a12 = a[:half_m, :half_k], a[:half_m, half_k:]
    a21, a22 = a[half_m:, :half_k], a[half_m:, half_k:]
    b11, b12 = b[:half_k, :half_n], b[:half_k, half_n:]
    b21, b22 = b[half_k:, :half_n], b[half_k:, half_n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * half_m, 2 * half_n), np.int64)
    out[half_m:, :half_n] = p2 + p4
    out[:half_m, half_n:] = p3 + p5
    p1 += p4
    np.add(p1, p7 - p5, out=out[:half_m, :half_n])
    p1 += p6 - p4
    np.add(p1, p3 - p2, out=out[half_m:, half_n:])
    return out[:m, :n]


class Heaps:
    """The best few (score, id) of every anchor; a higher score is better, then a smaller id.

    Each row is a heap of fixed size, kept in order. Of two heaps of the same anchor over different
    candidates, the merged one holds the best of both.
    """

    def __init__(self, rows: int, size: int):
        self.scores = np.full((rows, size), NONE)
        self.ids = np.full((rows, size), np.iinfo(np.int64).max)

    def merge(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        size = self.scores.shape[1]
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        order = np.lexsort((ids, ~scores), axis=1)[:, :size]  # ~ reverses the order of scores
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)

    def offer(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer a tile of scores (NONE: not to be taken) of candidates in order of their ids."""
        size = min(self.scores.shape[1], scores.shape[1])
        scores = scores.copy()
        best, of = [], []
        every = np.arange(len(scores))
        for _ in range(size):
            at = scores.argmax(axis=1)  # the first of equal scores, so the smallest id
            best.append(scores[every, at])
            of.append(ids[at])
            scores[every, at] = NONE
        if best:
            self.merge(rows, np.stack(best, axis=1), np.stack(of, axis=1))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and ids of what is there."""
        rows, at = np.nonzero(self.scores != NONE)
        return rows, self.scores[rows, at], self.ids[rows, at]


def share_of(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent * score / 100, rounded down or up, without products beyond 64 bits."""
    whole, rest = np.divmod(score, 100)
    rest = rest * percent
    return whole * percent + (-(-rest // 100) if up else rest // 100)


def _side(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a group in order of their ids."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = table.column("x").combine_chunks().flatten().to_numpy()
    x = flat.reshape(len(ids), dims).astype(np.int64)
    return ids[order], table.column("label").to_numpy()[order], x[order]


def _tiles(x: np.ndarray, y: np.ndarray):
    """Slices of anchors and of candidates with their scores."""
    for i in range(0, len(x), TILE_ROWS):
        for j in range(0, len(y), TILE_COLUMNS):
            rows, columns = slice(i, i + TILE_ROWS), slice(j, j + TILE_COLUMNS)
            yield (slice(i, min(i + TILE_ROWS, len(x))), slice(j, min(j + TILE_COLUMNS, len(y))),
                   strassen(x[rows], y[columns].T))


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and x (floor of scale times each component) of the rows that take part."""
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(
        c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        "embedding",
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
             & F.col("embedding").isNotNull() & finite("embedding")
             ).select("vec_id", "label", whole.alias("x"))


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3,
                   lowest: int = 50, highest: int = 95, scale: int = 256,
                   candidates: int = CANDIDATES, anchors: int = ANCHORS) -> DataFrame:
    """Candidates of other labels that come close to an anchor's positives.

    `vectors` has vec_id, label and embedding; anchors are the rows where `is_anchor` (of vec_id)
    holds. A row's score is its inner product with the anchor, of components floor(scale * c);
    higher scores come first, ties go to the smaller vec_id. An anchor's positives are the first
    `positives` other rows of its label. For each, the first `negatives` rows of another label
    whose score lies between `lowest` and `highest` percent of the positive's, both included, are
    returned: anchor_id, place (of the positive, from 1), positive_id, rank (from 1), negative_id,
    positive_score, negative_score. A positive with no such row gives none.

    Rows with a null vec_id, label or vector, or with null or non-finite components, take no part,
    nor do those of another length than most have (ties: the longer one). Components beyond 2^24
    in size count as that. Rows that repeat an anchor's vec_id are its own and are neither
    positives nor negatives; of several anchor rows with one vec_id, the one with the smallest
    label, then vector, is the anchor. Other repeated rows are candidates each. Further columns are
    ignored; an empty table gives no rows.

    All anchors are compared with all rows, in groups of about `anchors` by `candidates` rows that
    hashes deal out evenly, whatever the labels. A group sends at most `positives` entries for an
    anchor in the first round and `negatives` for each positive in the second.
    """
    spark = vectors.sparkSession
    schema = ("anchor_id long, place int, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")
    rows = usable(vectors, scale)
    length = rows.groupBy(F.size("x").alias("dims")).count().filter("dims > 0").orderBy(
        F.desc("count"), F.desc("dims")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dims = length.dims
    rows = rows.filter(F.size("x") == dims)
    chosen = stored(
        rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("one"))
        .select("vec_id", "one.label", "one.x"), "anchors")
    blocks = max(-(-length["count"] // candidates),
                 min(partitions_of(spark), -(-length["count"] // LEAST_CANDIDATES)))
    slabs = max(1, -(-chosen.count() // anchors))

    def dealt(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64(F.lit(own), "vec_id", "label", "x"), F.lit(n)).cast("int")
        return df.withColumn(own, number).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    right = dealt(rows, "block", blocks, "slab", slabs).groupBy("block", "slab")

    def compared(left: DataFrame, search, kinds: str) -> DataFrame:
        return dealt(left, "slab", slabs, "block", blocks).groupBy("block", "slab").cogroup(
            right).applyInArrow(search, kinds)

    def first_round(left: pa.Table, own: pa.Table) -> pa.Table:
        ids, labels, x = _side(left, dims)
        of, other, y = _side(own, dims)
        heaps = Heaps(len(ids), positives)
        for a, b, scores in _tiles(x, y):
            fits = (labels[a, None] == other[None, b]) & (ids[a, None] != of[None, b])
            heaps.offer(a, np.where(fits, scores, NONE), of[b])
        row, score, found = heaps.entries()
        return pa.table({"anchor_id": ids[row], "score": score, "positive_id": found})

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    found = compared(chosen, first_round, "anchor_id long, score long, positive_id long")
    found = found.withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= positives)
    listed = found.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "score", "positive_id"))).alias("own"))
    found = stored(
        chosen.join(listed, F.col("vec_id") == F.col("anchor_id")).select(
            "vec_id", "label", "x", F.col("own.score").alias("scores"),
            F.col("own.positive_id").alias("positives")), "positives")

    def second_round(left: pa.Table, own: pa.Table) -> pa.Table:
        ids, labels, x = _side(left, dims)
        of, other, y = _side(own, dims)
        order = np.argsort(left.column("vec_id").to_numpy(), kind="stable")
        limits = np.zeros((len(ids), positives, 2), np.int64)
        limits[:, :, 0] = 1  # above the upper limit: nothing fits
        for i, scores in enumerate(left.column("scores").take(pa.array(order)).to_pylist()):
            own_scores = np.array(scores, np.int64)
            limits[i, :len(scores), 0] = share_of(own_scores, lowest, True)
            limits[i, :len(scores), 1] = share_of(own_scores, highest, False)
        heaps = [Heaps(len(ids), negatives) for _ in range(positives)]
        for a, b, scores in _tiles(x, y):
            scores = np.where(labels[a, None] != other[None, b], scores, NONE)
            for place, heap in enumerate(heaps):
                low, high = limits[a, place, :1], limits[a, place, 1:]
                heap.offer(a, np.where((scores >= low) & (scores <= high), scores, NONE), of[b])
        entries = [heap.entries() for heap in heaps]
        places = [np.full(len(e[0]), place + 1, np.int32) for place, e in enumerate(entries)]
        row, score, negative = (np.concatenate([e[k] for e in entries]) for k in range(3))
        return pa.table({"anchor_id": ids[row], "place": np.concatenate(places),
                         "negative_score": score, "negative_id": negative})

    near = compared(found, second_round,
                    "anchor_id long, place int, negative_score long, negative_id long")
    best = Window.partitionBy("anchor_id", "place").orderBy(
        F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    by_place = found.select(
        F.col("vec_id").alias("anchor_id"),
        F.posexplode(F.arrays_zip("scores", "positives")).alias("at", "one")).select(
        "anchor_id", (F.col("at") + 1).alias("place"), F.col("one.positives").alias("positive_id"),
        F.col("one.scores").alias("positive_score"))
    return near.join(by_place, ["anchor_id", "place"]).select(
        "anchor_id", "place", "positive_id", "rank", "negative_id", "positive_score",
        "negative_score")
