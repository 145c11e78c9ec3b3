"""Stored instances: one injected table with its manifest of questions and answers.

Tables lie in folders of versions, one per run that wrote them, and are never changed. Manifests
name the version that counts; all manifests of a run are written at once, into a partition for each
dataset and seed, and replace those of earlier runs. A run that dies before that write leaves every earlier
instance as it was, and one that dies after it has nothing more to do than to clear away versions
that no manifest names. An instance whose manifest is not OK is out of use.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.operators.inject import Injection
from tabprobe.operators.set_answers import MOST_SENT, answer_questions
from tabprobe.sources.shared import cut
from tabprobe.sources.stacked import (
    COLUMN, KINDS, columns_of, physical_schema, pressed, read_places, restored, widths,
)

#: Folders that instances lie in, one level each.
FOLDERS = "dataset_name string, seed bigint, injector string, params_id string"
_FOLDERS = [f.split()[0] for f in FOLDERS.split(", ")]
# ``effects`` and ``answer`` differ by injector and template; they are kept as JSON text.
MANIFEST_SCHEMA = f"""
    instance string, version string, base_dataset string, target string, row_key string,
    status string, reason string, bytes bigint, columns array<{COLUMN}>,
    phenomenon struct<injector_type: string, params: string, effects: string>,
    templates_applied array<string>,
    qa_pairs array<struct<template_id: string, category: string, answer_format: string,
        question: string, slot_assignments: map<string,string>, answer: string>>,
    injector string, params_id string, dataset_name string, seed bigint
"""
#: Manifests lie in a partition for each of these.
_PARTS = ["dataset_name", "seed"]


def params_id(params: dict) -> str:
    listed = json.dumps({k: str(v) for k, v in params.items()}, sort_keys=True)
    return hashlib.md5(listed.encode()).hexdigest()[:8]


def instance_name(dataset: str, seed: int, injector: str, params: dict) -> str:
    """Name of an instance; injections with other parameters get their own."""
    return f"{dataset}/seed_{seed}/{injector}/{params_id(params)}"


def new_version() -> str:
    return uuid.uuid4().hex


def _escaped(name: str) -> str:
    """A partition value as a folder name, as Spark's readers undo it."""
    special = set("\"#%'*/:=?\\{}[]^")
    return "".join(f"%{ord(c):02X}" if c in special or ord(c) < 32 else c for c in name)


def _folder(dataset: str, seed: int, injector: str, own_params: str) -> str:
    return "/".join(f"{k}={_escaped(str(v))}" for k, v in zip(
        _FOLDERS, (dataset, seed, injector, own_params)))


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a folder, as its file system has it."""
    files, place = _file_system(spark, path)
    return files.getContentSummary(place).getLength()


def store_table(
    spark: SparkSession, root: str, dataset: str, seed: int, injection: Injection, version: str
) -> int:
    """Write the injected table (and its groups) as a version of its own; returns its size.

    Nothing reads it until a manifest names it.
    """
    folder = _folder(dataset, seed, injection.injector, params_id(injection.params))
    path = f"{root}/tables/{folder}/version={version}"
    pressed(injection.table).write.parquet(path)
    if injection.groups is not None:  # may be as many as the table has values
        injection.groups.write.parquet(f"{root}/groups/{folder}/version={version}")
    return stored_bytes(spark, path)


def manifest_row(
    dataset: str, seed: int, injection: Injection, qa_pairs: list[dict], base: str, target: str,
    row_key: str, version: str, size: int,
) -> dict:
    usable = injection.status == "OK"
    return {
        "instance": instance_name(dataset, seed, injection.injector, injection.params),
        "version": version if usable else None, "base_dataset": base, "target": target,
        "row_key": row_key, "status": injection.status, "reason": injection.reason,
        "bytes": size if usable else 0,
        "columns": columns_of(injection.table.schema) if usable else [],
        "phenomenon": {
            "injector_type": injection.injector,
            "params": json.dumps(injection.params, ensure_ascii=False, default=str),
            "effects": json.dumps(injection.effects, ensure_ascii=False, default=str),
        },
        "templates_applied": [qa["template_id"] for qa in qa_pairs],
        "qa_pairs": qa_pairs if usable else [],
        "dataset_name": dataset, "seed": seed, "injector": injection.injector,
        "params_id": params_id(injection.params),
    }


def write_manifests(manifests: DataFrame, root: str) -> None:
    """Write all manifests of a run at once; each replaces its instance's earlier one only.

    The other manifests of the same datasets and seeds are carried over, so two runs must not
    write instances of one dataset and seed at a time.
    """
    spark = manifests.sparkSession
    touched = F.broadcast(manifests.select(*_PARTS).distinct()) if manifests.count() <= MOST_SENT \
        else manifests.select(*_PARTS).distinct()
    kept = read_manifests(spark, root).join(touched, _PARTS, "left_semi").join(
        manifests.select("instance"), "instance", "left_anti")
    # Read before its files are replaced.
    table = cut(kept.select(*manifests.columns).unionByName(manifests))
    table.hint("rebalance", *_PARTS).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).json(f"{root}/manifests")


def commit_instances(spark: SparkSession, root: str, rows: list[dict]) -> None:
    """Make the instances of one table count, and clear away what no manifest names any more."""
    if not rows:
        return
    write_manifests(spark.createDataFrame(rows, MANIFEST_SCHEMA), root)
    for row in rows:  # the few injections of one table
        folder = _folder(*(row[k] for k in _FOLDERS))
        for kind in ("tables", "groups"):
            files, place = _file_system(spark, f"{root}/{kind}/{folder}")
            for entry in files.listStatus(place) if files.exists(place) else []:
                if entry.getPath().getName() != f"version={row['version']}":
                    files.delete(entry.getPath(), True)


def write_instance(
    spark: SparkSession, root: str, dataset: str, seed: int, injection: Injection,
    qa_pairs: list[dict], base: str = "", target: str = "", row_key: str = "row_id",
) -> str:
    """Write one instance; a rejected injection leaves a manifest that says so, and no table."""
    version, size = new_version(), 0
    if injection.status == "OK":
        size = store_table(spark, root, dataset, seed, injection, version)
    row = manifest_row(
        dataset, seed, injection, qa_pairs, base, target, row_key, version, size)
    commit_instances(spark, root, [row])
    return row["instance"]


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests, those of rejected instances included."""
    if not exists(spark, f"{root}/manifests"):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/manifests")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The instances that are out of use, with the reason."""
    return read_manifests(spark, root).where(F.col("status") != "OK").select(
        *_FOLDERS, "instance", "status", "reason", "templates_applied")


def _manifest(spark: SparkSession, root: str, instance: str):
    found = read_manifests(spark, root).where(
        (F.col("instance") == instance) & (F.col("status") == "OK")).first()
    if found is None:
        raise ValueError(f"no usable instance {instance}")
    return found


def _version_path(root: str, kind: str, manifest) -> str:
    return f"{root}/{kind}/{_folder(*(manifest[k] for k in _FOLDERS))}/version={manifest['version']}"


def read_groups(spark: SparkSession, root: str, instance: str) -> DataFrame:
    """Every group of an instance with its mean and side, however many there are."""
    return spark.read.parquet(_version_path(root, "groups", _manifest(spark, root, instance)))


def read_table(spark: SparkSession, root: str, instance: str) -> DataFrame:
    """The table of one instance, with the names and types that it was stored with."""
    found = _manifest(spark, root, instance)
    columns = [c.asDict() for c in found["columns"]]
    held = {k: sum(c["kind"] == k for c in columns) for k in KINDS}
    rows = spark.read.schema(physical_schema(held)).parquet(_version_path(root, "tables", found))
    return restored(rows, columns)


def version_key(*parts: str) -> Column:
    """Names one version of one instance, from manifest columns or from folder names."""
    return F.concat_ws("/", *parts)


def read_tables(spark: SparkSession, root: str, manifests: DataFrame) -> DataFrame:
    """Rows of the tables of many instances in one scan, see :func:`stacked.read_places`.

    `instance` is the :func:`version_key` of the folders; a join with the same key of manifests
    reads the folders of those only.
    """
    held = widths(manifests.select("columns"))
    rows = read_places(spark, f"{root}/tables", held, f"{FOLDERS}, version string")
    return rows.withColumn("instance", version_key(*_FOLDERS, "version"))


def discover_instances(
    spark: SparkSession, root: str, dataset: str | None = None,
    injector: str | list[str] | None = None, suffixes: list[str] | None = None,
) -> DataFrame:
    """Usable instances, smallest table first.

    ``dataset`` must equal the name, ``injector`` entries are substrings, ``suffixes`` are
    endings of the dataset name (``_100`` keeps the tables small enough to show whole).
    """
    found = read_manifests(spark, root).where(F.col("status") == "OK")
    if dataset:
        found = found.where(F.col("dataset_name") == dataset)
    if injector:
        listed = [injector] if isinstance(injector, str) else injector
        found = found.where(F.greatest(*[F.col("injector").contains(i) for i in listed], F.lit(False)))
    if suffixes:
        ends = [F.col("dataset_name").endswith(s) for s in suffixes]
        found = found.where(F.greatest(*ends, F.lit(False)))
    return found.orderBy("bytes", "instance")


def answers_of(spark: SparkSession, root: str, manifests: DataFrame) -> DataFrame:
    """Answers to all questions of some manifests: (instance, template_id, answer, status, reason).

    All tables are read and all questions answered together, whether or not the manifests are
    written yet.
    """
    if not exists(spark, f"{root}/tables"):
        return spark.createDataFrame([], "instance string, template_id string, answer string,"
                                         " status string, reason string")
    keyed = manifests.withColumn("key", version_key(*_FOLDERS, "version"))
    questions = keyed.select(
        F.col("key").alias("instance"), "injector", F.explode("qa_pairs").alias("qa"), "columns",
        "row_key", F.col("phenomenon.effects").alias("effects"),
    ).select("*", "qa.template_id", F.col("qa.slot_assignments").alias("slots")).drop("qa")
    found = answer_questions(questions, read_tables(spark, root, manifests))
    names = keyed.select("key", F.col("instance").alias("name"))
    return found.join(names, F.col("instance") == F.col("key")).select(
        F.col("name").alias("instance"), "template_id", "answer", "status", "reason")


def refresh_answers(spark: SparkSession, root: str) -> DataFrame:
    """Recompute every stored answer from its table; one row per question with its status.

    A question without an answer operator keeps the answer it has. The answers of all instances
    come from the same few aggregates, and their manifests are written together.
    """
    manifests = cut(read_manifests(spark, root).where(F.col("status") == "OK"))
    answers = cut(answers_of(spark, root, manifests))
    new = answers.where(F.col("status") != "SKIP").groupBy("instance").agg(
        F.map_from_entries(F.collect_list(F.struct("template_id", "answer"))).alias("new"))
    entry = F.transform("qa_pairs", lambda qa: F.when(
        F.map_contains_key("new", qa["template_id"]),
        qa.withField("answer", F.element_at("new", qa["template_id"]))).otherwise(qa))
    changed = manifests.join(new, "instance").withColumn("qa_pairs", entry).drop("new")
    write_manifests(changed.select(*manifests.columns), root)
    return answers.join(
        manifests.select("instance", F.col("dataset_name").alias("dataset"), "injector"), "instance"
    ).select("dataset", "instance", "injector", "template_id", "answer", "status", "reason")


def as_text(value: str | list[str] | None) -> str | None:
    return ", ".join(value) if isinstance(value, list) else value


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
