"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs after learned rotations. A code is split into substrings of eight
bits, each with an index from value to rows. Codes within a Hamming radius of a query's have at
least one substring within the radius divided by their number (pigeonhole), so probing those
values finds all of them; what lies within the radius is ranked by its real distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.letters import bounded_sample

#: Rows of an index and queries that one task compares.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096
_VALUES = np.arange(256, dtype=np.uint8)


@dataclass(frozen=True)
class Codes:
    """Rotations that make codes, and the Hamming radius that is searched."""

    dims: int
    centre: np.ndarray
    rotations: np.ndarray  # [dims, bits]
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((vectors - self.centre) @ self.rotations > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learned(sample: np.ndarray, neighbours: int, min_bits: int = 128, recall: float = 0.98,
            rounds: int = 30, seed: int = 11, queries: int = 500) -> Codes:
    """Iterative quantisation: the rotation and the signs of the rotated sample in turns.

    Rotations are learned from different beginnings until there are `min_bits` bits. The radius is
    the smallest that holds the share `recall` of the sample's own nearest neighbours.
    """
    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    centre = sample.mean(axis=0)
    x = sample - centre
    width = min(dims, min_bits)
    base = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]  # principal axes, the longest first
    y = x @ base
    rotations = []
    while sum(r.shape[1] for r in rotations) < min_bits:
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        rotations.append(base @ turn)
    joined = np.concatenate(rotations, axis=1)
    joined = joined[:, :joined.shape[1] // 8 * 8] if joined.shape[1] >= 8 else joined
    codes = Codes(dims, centre, joined, 0)
    own = codes.of(sample)
    apart = []
    for q in rng.permutation(n)[:queries]:
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[:min(neighbours, n - 1)]
        apart.append(distances(own[near], own[q]))
    apart = np.sort(np.concatenate(apart)) if apart else np.zeros(0, np.int64)
    radius = int(apart[min(int(len(apart) * recall), len(apart) - 1)]) if len(apart) else 0
    return Codes(dims, centre, joined, radius)


class Index:
    """Rows of a block by the values of their codes' substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            cut = np.searchsorted(codes[order, j], np.arange(257))
            self.rows.append([order[a:b] for a, b in zip(cut, cut[1:])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius."""
        reach = radius // len(self.rows)
        seen = np.zeros(len(self.codes), bool)
        for j, rows in enumerate(self.rows):
            for value in np.flatnonzero(np.bitwise_count(_VALUES ^ code[j]) <= reach):
                seen[rows[value]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.codes[rows], code) <= radius]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good
                & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 10, most_sample: int = 8_000,
            seed: int = 11) -> DataFrame:
    """The `k` nearest rows found for each row where `is_query` holds, among all other rows.

    `vectors` has vec_id and embedding. Returns query_id, rank (from 1), vec_id, score (Euclidean
    distance in double precision); ties go to the smaller vec_id. Rows with a null vec_id and
    vectors that are null, zero, or hold null or non-finite components take no part, nor do those
    of another length than most have. Rows that repeat the query's vec_id are its own and are no
    candidates; other repeated rows are candidates each. Where a block of rows has fewer than `k`
    codes within the radius, its nearest codes are ranked instead, so that `k` rows are found
    whenever there are as many.

    The codes are learned on the `most_sample` vectors with the smallest keyed hash of vec_id.
    Every row is indexed. Queries and rows are split into blocks and each pair of blocks is one
    group, so a task holds BLOCK_ROWS rows and BLOCK_QUERIES queries at a time (about).
    """
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(
        F.desc("count"), "dims").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == sizes.dims)
    queries = rows.filter(is_query)
    ids = bounded_sample(rows.select(F.col("vec_id").alias("doc_id")), most_sample, seed)
    sample = rows.join(F.broadcast(ids.distinct()), F.col("vec_id") == F.col("doc_id"),
                       "left_semi").orderBy("vec_id").limit(most_sample)
    vectors_of = sample.select("embedding").toArrow().column("embedding").combine_chunks()
    codes = learned(vectors_of.flatten().to_numpy().reshape(-1, sizes.dims), k, seed=seed)
    row_blocks = max(1, -(-sizes["count"] // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def block(seed: int, n: int):
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id", F.col("embedding")[0]), F.lit(n))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = rows.withColumn("rb", block(1, row_blocks)).withColumn(
        "qb", every(query_blocks))
    right = queries.withColumn("qb", block(2, query_blocks)).withColumn(
        "rb", every(row_blocks))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if not len(own) or not len(asked):
            return pd.DataFrame(found).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        vectors, ids = np.stack(own["embedding"].to_numpy()), own["vec_id"].to_numpy()
        index = Index(codes.of(vectors))
        points = np.stack(asked["embedding"].to_numpy())
        for query, point, code in zip(asked["vec_id"], points, codes.of(points)):
            near = index.within(code, codes.radius)
            near = near[ids[near] != query]
            if len(near) < k:
                others = np.flatnonzero(ids != query)
                order = np.argsort(distances(index.codes[others], code), kind="stable")
                near = others[order[:4 * k]]
            d = np.sqrt(((vectors[near] - point) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))[:k]
            found["query_id"] += [query] * len(best)
            found["vec_id"] += ids[near][best].tolist()
            found["score"] += d[best].tolist()
        return pd.DataFrame(found).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    blocks = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(
        search, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return blocks.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
