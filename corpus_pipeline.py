"""From raw documents to packed training sequences, as five stages over the whole corpus.

Each stage takes all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import language_id
from tabprobe.llm.exact_dedup import exact_duplicates
from tabprobe.llm.mixing import mixed
from tabprobe.llm.ngram_join import similar_groups
from tabprobe.llm.packing import pack
from tabprobe.llm.queries import WEIGHTS, domain, tokenizer
from tabprobe.sources.shared import shared_folder

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a text without letters has none."""
    model = language_id.train(docs.filter("lang is not null"), docs)
    found = language_id.identify(docs, model)
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN)
                        & (F.col("score") >= LEAST_SCORE))
    return kept.select(docs.columns)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose id is in `kept` (column doc_id), a null id included."""
    ids = kept.select(F.col("doc_id").alias("kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return _only(docs, exact_duplicates(docs).filter("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return _only(docs, similar_groups(docs).filter(
        "component_id is null or doc_id = component_id"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    taken = mixed(docs, domain(), weights=WEIGHTS).filter("copies > 0").select(
        F.col("doc_id").alias("taken_id"), "copies").groupBy("taken_id").agg(
        F.max("copies").alias("copies"))
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken["taken_id"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
                           ).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in sequences of at most 2048."""
    return pack(docs, tokenizer("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed),
]

#: Language scores and token ids are beyond SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = f"{shared_folder(spark).rstrip('/')}/stage{number}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
