"""Exact duplicates by a content sort.

Normalised texts are range-partitioned between sampled splitters (by their first characters, then
their digest) and sorted externally, so that equal texts are neighbours; neighbours are compared
in full by the window over the sorted rows. The range key has a last part, which is constant but for the few texts that fill a good part of
a partition: their copies are spread over many ranges, summed up there, and the sums are compared
in full once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import partitions_of, stored, texts_of

#: Rows of the sample for each range, and how many of them make a text a hot one.
SAMPLED_PER_RANGE = 40
HOT_IN_SAMPLE = 8

#: Characters of a text that splitters hold, before its digest; whole texts stay off the driver.
LEADING = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_duplicates(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each row of `docs` with the copy that stays for its text.

    Returns doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256.
    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Rows that
    repeat a doc_id with an equal text all count in group_size, and one of them is kept. A null
    doc_id never wins over another. Further columns of `docs` are ignored.

    Only the digests of hot texts and their sums are broadcast: a sample of SAMPLED_PER_RANGE rows
    for each range has at most an eighth as many (HOT_IN_SAMPLE). A hot text that the sample misses costs time, not rows.
    """
    ranges = ranges or partitions_of(docs.sparkSession)
    normal = texts_of(docs).select("doc_id", F.translate("text", UPPER, LOWER).alias("norm"))
    rows = docs.count()
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    hot = (
        normal.sample(share, seed=7).groupBy(F.xxhash64("norm").alias("digest"))
        .agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_IN_SAMPLE).select("digest")
    )
    salted = normal.withColumn("digest", F.xxhash64("norm")).join(
        F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left"
    ).select(
        "doc_id", "norm", "digest", F.substring("norm", 1, LEADING).alias("leading"),
        F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
        .otherwise(F.lit(0)).cast("long").alias("salt"),
    )
    near = Window.partitionBy("leading", "digest", "norm", "salt").orderBy(F.desc_nulls_last("doc_id"))
    all_near = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = salted.repartitionByRange(ranges, "leading", "digest", "salt").select(
        "doc_id", "salt", "norm",
        F.first("doc_id").over(all_near).alias("keep_id"),
        F.count("*").over(all_near).alias("group_size"),
        F.row_number().over(near).alias("place"),
    ).select(
        "doc_id", "salt", "keep_id", "group_size", "place", F.sha2("norm", 256).alias("text_sha256"),
        F.when((F.col("salt") > 0) & (F.col("place") == 1), F.col("norm")).alias("norm"),
    )
    parts = stored(parts, "exact-parts")  # without the texts
    whole = (
        parts.filter("norm is not null").groupBy("norm")
        .agg(F.max("keep_id").alias("keep"), F.sum("group_size").alias("size"),
             F.first("text_sha256").alias("text_sha256"))
        .select("text_sha256", "keep", "size")
    )
    return (
        parts.join(F.broadcast(whole), "text_sha256", "left")
        .select(
            "doc_id", F.coalesce("keep", "keep_id").alias("keep_id"),
            F.coalesce("size", "group_size").alias("group_size"), "place", "text_sha256",
        )
        .select(
            "doc_id", "keep_id", "group_size",
            ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )
