"""Rules for evaluation records: provider, run, table size, labels, empty answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe.functions.text import first_containing

# Run label by the first substring found in the file path, in this order.
RUN_RULES = [
    ("blind", "blind"),
    ("all_tools", "all_tools"),
    ("csv_context", "csv_context"),
    ("semantic_only", "semantic_only"),
    ("python_semantic", "semantic"),
    ("python_only", "python_only"),
    ("semantic", "semantic"),
    ("tools", "tools"),
    ("raw", "raw"),
]
# Grades in report order, and the tool components that have a column of their own.
GRADES = ["CORRECT", "PARTIAL", "INCORRECT"]
COMPONENTS = ["overview", "feature_importances", "shape_function"]


def provider(model: Column) -> Column:
    return (
        F.when(model.startswith("claude"), "Anthropic")
        .when(model.rlike("^(gpt-|o1|o3|o4)"), "OpenAI")
        .otherwise("Ollama")
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def run_label(path: Column) -> Column:
    """Run name: the rules are tried on the file name first, then on the whole path."""
    stem = file_stem(path)
    by_path = first_containing(F.lower(path), RUN_RULES, stem)
    return first_containing(F.lower(stem), RUN_RULES, by_path)


def dataset_size(dataset: Column) -> Column:
    """Row count in the name's ``_<digits>`` suffix, else 0."""
    return F.coalesce(F.regexp_extract(dataset, r"_(\d+)$", 1).try_cast("bigint"), F.lit(0))


def template_label(template_id: Column) -> Column:
    return F.replace(
        F.replace(template_id, F.lit("_v0"), F.lit("")), F.lit("_v1"), F.lit(" v1")
    )


def is_empty_answer(answer: Column) -> Column:
    return F.coalesce(F.trim(answer), F.lit("")) == ""
