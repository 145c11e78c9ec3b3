"""Exact-size keyed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.draws import digest

_PREFIX = 5  # hex digits: about a million buckets, whatever the table size


def sample_cutoff(df: DataFrame, key: str, size: int, seed: int, tag: str = "sample") -> str | None:
    """The largest digest in a sample of the ``size`` smallest row digests (null if size is 0).

    Bucket counts by digest prefix locate the bucket in which the sample ends; only the rows of
    that one bucket, about a millionth of the table, are then sorted.
    """
    if size <= 0:
        return None
    marked = df.select(_ordered_digest(seed, tag, key).alias("digest")).withColumn(
        "prefix", F.substring("digest", 1, _PREFIX)
    )
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        marked.groupBy("prefix").agg(F.count("*").alias("held"))
        .withColumn("ahead", F.coalesce(F.sum("held").over(upto), F.lit(0)))
        .where((F.col("ahead") < size) & (F.col("ahead") + F.col("held") >= size))
        .first()
    )
    if edge is None:
        return "g"  # every digest sorts below: the sample is the whole table
    place = Window.orderBy("digest")
    return (
        marked.where(F.col("prefix") == edge["prefix"])
        .withColumn("place", F.row_number().over(place))
        .where(F.col("place") == size - edge["ahead"])
        .first()["digest"]
    )


def _ordered_digest(seed: int, tag: str, key: str) -> Column:
    return F.concat(digest(seed, tag, key), F.lit(":"), F.col(key).cast("string"))


def in_sample(cutoff: str | None, key: str, seed: int, tag: str = "sample") -> Column:
    """Whether a row belongs to the sample that ends at the cutoff."""
    if cutoff is None:
        return F.lit(False)
    return _ordered_digest(seed, tag, key) <= F.lit(cutoff)


def sample_exact(df: DataFrame, key: str, size: int, seed: int, tag: str = "sample") -> DataFrame:
    """Exactly ``size`` rows without replacement (all rows if there are fewer)."""
    return df.where(in_sample(sample_cutoff(df, key, size, seed, tag), key, seed, tag))
