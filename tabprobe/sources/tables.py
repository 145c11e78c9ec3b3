"""Tables, profiles and result records on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.records import run_label
from tabprobe.operators.profiling import flat_profile, nested_profile
from tabprobe.operators.ranks import order_statistics

# Cell texts that a table reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

PROFILE_SCHEMA = """
    dataset string, target string,
    columns map<string, struct<kind: string, dtype: string, unique_count: bigint>>,
    by_kind map<string, array<string>>
"""

# ``input`` and ``expected_answer`` may be text, a list or a record; they are kept as JSON text.
RESULT_SCHEMA = """
    dataset string, injector string, template_id string, category string, model string,
    question string, expected_answer string, model_answer string, answer_format string,
    metrics struct<input_tokens: bigint, output_tokens: bigint, ttft_s: double,
                   total_latency_s: double>,
    tools_enabled array<string>, tool_use array<struct<tool: string, input: string>>,
    thinking string, grade string, reasoning string
"""


def read_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """CSV with a header as text; a quote inside quotes is doubled.

    Cells that hold line breaks have to be asked for, as such files cannot be split.
    """
    return spark.read.csv(
        path, header=True, inferSchema=False, quote='"', escape='"', multiLine=line_breaks
    )


def load_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    fmt: str | None = None, line_breaks: bool = False,
) -> DataFrame:
    """A Parquet folder, or CSV with a header, with missing tokens as null.

    Without ``fmt``, a name that ends in .csv (or .csv.gz) is CSV and any other Parquet. Without a
    schema the CSV's types are found in one aggregate over its text: whole numbers,
    else numbers, else true/false, else text.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "parquet":
        return spark.read.parquet(path)
    text = read_csv(spark, path, line_breaks)
    cells = text.select(*[
        F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns
    ])
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        types = {f.name: f.dataType for f in wanted.fields}
    else:
        types = infer_types(cells)
    return cells.select(*[
        F.trim(F.col(f"`{c}`")).try_cast(types[c]).alias(c)
        if not isinstance(types[c], T.StringType) else F.col(f"`{c}`")
        for c in cells.columns
    ])


def infer_types(cells: DataFrame) -> dict[str, T.DataType]:
    """The narrowest of bigint, double, boolean and string that holds every cell of a column."""
    options = [T.LongType(), T.DoubleType(), T.BooleanType()]
    fits = cells.agg(*[
        F.struct(F.count(F.col(f"`{c}`")).alias("cells"), *[
            F.count(F.trim(F.col(f"`{c}`")).try_cast(t)).alias(f"t{j}") for j, t in enumerate(options)
        ]).alias(f"c{i}")
        for i, c in enumerate(cells.columns)
    ]).first()
    found = {}
    for i, name in enumerate(cells.columns):
        counts = fits[f"c{i}"]
        found[name] = next(
            (t for j, t in enumerate(options) if counts["cells"] and counts[f"t{j}"] == counts["cells"]),
            T.DoubleType() if not counts["cells"] else T.StringType(),
        )
    return found


def load_text_table(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """CSV with every cell as trimmed text."""
    text = read_csv(spark, path, line_breaks)
    return text.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in text.columns])


def head_rows(df: DataFrame, n: int, row_id: str | None = None) -> DataFrame:
    """The first n rows: by row id where there is one (repeatable), else any n rows read first."""
    return df.where(F.col(row_id) <= n) if row_id else df.limit(n)


def size_variants(
    df: DataFrame, sizes: tuple[int, ...] = (100, 500, 1000), row_id: str = "row_id"
) -> DataFrame:
    """Nested copies of the first n rows of a table by row id, tagged ``size``.

    A size beyond the table is left out. Row ids are distinct and may have gaps: the last id of
    each size is found as an order statistic.
    """
    wanted = df.sparkSession.createDataFrame([(s - 1,) for s in sorted(set(sizes))], "k long")
    found = order_statistics(df, [], row_id, wanted)
    last = {r["k"] + 1: r[row_id] for r in found.collect()}  # one row per size
    held = [F.when(F.col(row_id) <= last[s], F.lit(s).cast("bigint")) for s in sorted(last)]
    sizes_held = F.array_compact(F.array(*held)) if held else F.array().cast("array<bigint>")
    return df.withColumn("size", F.explode(sizes_held))


def save_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(fmt).save(path)


def save_profile(profiles: DataFrame, path: str, rewrite: bool = False) -> None:
    """Nested JSON per dataset; kept as it is when already there, unless rewritten."""
    nested_profile(profiles).write.mode("overwrite" if rewrite else "ignore").json(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return flat_profile(spark.read.schema(PROFILE_SCHEMA).json(path))


def load_records(
    spark: SparkSession, paths: list[str] | str, spread_arrays: bool = False
) -> DataFrame:
    """Result files as one table tagged with the run that each file names.

    A line holds a record or a JSON array of records. An array spread over several lines has to be
    asked for; such a file is read whole by one task, so store it as lines once.
    """
    rows = spark.read.schema(RESULT_SCHEMA).json(paths, multiLine=spread_arrays)
    return rows.withColumn("run", run_label(F.col("_metadata.file_path")))


def union_records(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Result sets one below the other; columns that one lacks are null there."""
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def split_results(results: DataFrame, path: str, key: str = "template_id") -> DataFrame:
    """Write the records into one folder per key value; return how many each one got."""
    results.write.mode("overwrite").partitionBy(key).json(path)
    return results.groupBy(key).agg(F.count("*").alias("records"))
