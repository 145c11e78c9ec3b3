"""Building instances: match, inject one phenomenon per copy, answer, keep or reject, report."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.operators.columns import drop_ids
from tabprobe.operators.inject import Injection, inject_each
from tabprobe.operators.profiling import profile
from tabprobe.operators.set_summaries import summaries_of
from tabprobe.operators.summaries import (
    feature_summary, importance, interactions_of, overview, shape_function,
)
from tabprobe.functions.numbers import number_columns
from tabprobe.plans.matching import match_all, required_phenomena, run_report
from tabprobe.plans.templates import templates_frame
from tabprobe.sources.instances import (
    FOLDERS, MANIFEST_SCHEMA, answers_of, commit_instances, discover_instances, exists, manifest_row,
    new_version, read_tables, store_table, version_key,
)
from tabprobe.sources.shared import cut

PARALLEL = 4
_EFFECTS = "dataset string, injector string, params_key string, status string, reason string"
_ANSWERS = (
    "dataset string, injector string, params_key string, template_id string, answer string,"
    " status string, reason string"
)


def values_of(tables: dict[str, DataFrame]):
    """Reader of the cells of chosen columns, for the slots that hold a column's value."""
    def read(pairs: list[tuple[str, str]]) -> DataFrame:
        parts = []
        for dataset in sorted({d for d, _ in pairs}):
            names = [c for d, c in pairs if d == dataset]
            texts = tables[dataset].select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
            parts.append(texts.unpivot([], [f"`{c}`" for c in names], "column", "value").select(
                F.lit(dataset).alias("dataset"), "column", "value"
            ))
        return reduce(DataFrame.unionByName, parts)

    return read


def build_instances(
    spark: SparkSession, table: DataFrame, dataset: str, root: str, seed: int = 42,
    key: str = "row_id", template_ids: list[str] | None = None,
) -> DataFrame:
    """Match, inject, answer and store one table; returns the run report.

    An injection is kept only if every question that asked for it has an answer. The loop is
    over the few injections of one table; each of its steps is a job over all rows.
    """
    profiles = cut(profile(table, dataset))
    matches = cut(match_all(
        templates_frame(spark), profiles, values_of({dataset: table}), seed, template_ids
    ))
    by_id = {r["template_id"]: r for r in matches.where("compatible").collect()}
    specs = required_phenomena(matches).orderBy("injector", "params_key").collect()
    facts = profiles.where((F.col("kind") == "id_no") | F.col("is_target")).collect()
    ids = sorted(r["column"] for r in facts if r["kind"] == "id_no")
    target = next(r["column"] for r in facts if r["is_target"])

    version = new_version()

    def injected(spec) -> tuple[Injection, int]:
        result = inject_each(table, [(spec["injector"], spec["params"])], seed, key, ids)[0]
        if spec["injector"] == "fi_top_features":
            result.table = drop_ids(result.table, ids)
        size = store_table(spark, root, dataset, seed, result, version) if (
            result.status == "OK") else 0
        return result, size

    # Independent jobs of one table, a few at a time.
    with ThreadPoolExecutor(PARALLEL) as pool:
        results = list(pool.map(injected, specs))
    rows = []
    for spec, (result, size) in zip(specs, results):
        asked = [by_id[t] for t in spec["templates"]] if result.status == "OK" else []
        qa_pairs = [{
            "template_id": m["template_id"], "category": m["category"],
            "answer_format": m["answer_format"], "question": m["question"],
            "slot_assignments": m["slots"], "answer": None,
        } for m in asked]
        rows.append(manifest_row(
            dataset, seed, result, qa_pairs, dataset, target, key, version, size))
    # All questions of all injections together; nothing of this run can be read by others yet.
    drafts = spark.createDataFrame([r for r in rows if r["qa_pairs"]], MANIFEST_SCHEMA)
    answered = {(r["instance"], r["template_id"]): r
                for r in answers_of(spark, root, drafts).collect()} if specs else {}
    effects, answers = [], []
    for spec, row in zip(specs, rows):
        name = (dataset, spec["injector"], spec["params_key"])
        for qa in row["qa_pairs"]:
            found = answered[row["instance"], qa["template_id"]]
            qa["answer"] = found["answer"]
            answers.append((
                *name, qa["template_id"], found["answer"], found["status"], found["reason"]))
        open_ones = [qa["template_id"] for qa in row["qa_pairs"] if qa["answer"] is None]
        if open_ones:
            row.update(status="REJECTED", reason="no answer: " + ", ".join(open_ones),
                       version=None, bytes=0, columns=[], qa_pairs=[])
        effects.append((*name, row["status"], row["reason"]))
    commit_instances(spark, root, rows)
    return run_report(
        matches, spark.createDataFrame(effects, _EFFECTS), spark.createDataFrame(answers, _ANSWERS)
    )


def summarise_table(df: DataFrame, outcome: str) -> dict[str, DataFrame]:
    """Overview, shape functions, feature summary and interactions of one table."""
    shapes = cut(shape_function(df, outcome))
    numbers = [n for n in number_columns(df) if n != outcome]
    parts = {
        "overview": overview(df, outcome), "shapes": shapes, "importance": importance(shapes),
        "features": feature_summary(df, outcome, shapes),
    }
    if len(numbers) > 1:
        parts["interactions"] = interactions_of(df, outcome, numbers)
    return parts


#: Parts of a summary, each a table of all instances of a run.
PARTS = ("overview", "shapes", "importance", "features", "interactions")
_DONE = "instance string, version string, status string, run string"


def summarise_instances(
    spark: SparkSession, root: str, force: bool = False, suffixes: list[str] | None = None
) -> DataFrame:
    """Summaries of every stored instance that has none yet: one status row per instance.

    An instance is finished when its summary was made of the version that now counts, so a table
    that was built anew is summarised anew. All that are not are summarised together: each part is
    one aggregate over all their tables and one table of the run. The list of what the run has
    finished is written last and makes it count; a run that dies is made up for by the next.
    """
    instances = cut(discover_instances(spark, root, suffixes=suffixes))
    done = read_done(spark, root).where(F.col("status") == "generated")
    known = ["instance", "version"]
    todo = instances if force else instances.join(done.select(*known), known, "left_anti")
    has_target = F.exists("columns", lambda c: c["name"] == F.col("target"))
    todo = cut(todo.withColumn("status", F.when(has_target, "generated").otherwise("failed")))
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"  # later runs sort behind
    usable = todo.where(F.col("status") == "generated")
    if usable.count():
        folders = [f.split()[0] for f in FOLDERS.split(", ")]
        keyed = usable.withColumn("key", version_key(*folders, "version"))
        parts = summaries_of(read_tables(spark, root, usable), keyed.select(
            F.col("key").alias("instance"), "target", "columns"))
        names = keyed.select(F.col("key"), F.col("instance").alias("name"))
        for part in PARTS:
            table = parts[part].join(names, F.col("instance") == F.col("key"))
            table.drop("instance", "key").withColumnRenamed("name", "instance").hint(
                "rebalance", "instance").write.parquet(f"{root}/summaries/{part}/run={run}")
    todo.select("instance", "version", "status").write.parquet(f"{root}/summaries/done/run={run}")
    return instances.select("instance").join(
        todo.select("instance", "status"), "instance", "left").select(
        "instance", F.coalesce("status", F.lit("skipped")).alias("status"))


def read_done(spark: SparkSession, root: str) -> DataFrame:
    """The last run that summarised each instance, and the version it did."""
    path = f"{root}/summaries/done"
    if not exists(spark, path):
        return spark.createDataFrame([], _DONE)
    last = F.max_by(F.struct("version", "status"), "run").alias("last")
    return spark.read.schema(_DONE).parquet(path).groupBy("instance").agg(
        last, F.max("run").alias("run")).select("instance", "last.*", "run")


def read_summaries(spark: SparkSession, root: str, part: str) -> DataFrame:
    """One part of the summaries of all instances, as their last runs left it."""
    done = read_done(spark, root).where(F.col("status") == "generated").select("instance", "run")
    return spark.read.parquet(f"{root}/summaries/{part}").join(
        done, ["instance", "run"], "left_semi").drop("run")


def read_summary(spark: SparkSession, root: str, part: str, instance: str) -> DataFrame:
    """One part of the summary of one instance, as :func:`summarise_table` gives it."""
    return read_summaries(spark, root, part).where(F.col("instance") == instance).drop("instance")


def summary_counts(statuses: DataFrame) -> DataFrame:
    """How many instances were summarised, left out as finished, and not usable."""
    return statuses.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("generated", "skipped", "failed")])
