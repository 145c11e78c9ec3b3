import json

import pytest
from pyspark.sql import functions as F

from tabprobe.operators.profiling import profile, profile_all
from tabprobe.sources import tables as T


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "t.csv"
    rows = ["n,x,flag,word,hole", "1,1.5,true, a ,NA", "2,NaN,false,b,", "3,2,True,n/a,null"]
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_load_table_infers_types_and_blanks_missing_tokens(spark, csv):
    df = T.load_table(spark, csv)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "double"]
    rows = [tuple(r) for r in df.orderBy("n").collect()]
    assert rows[1] == (2, None, False, "b", None)
    assert rows[2][3] is None


def test_load_table_with_schema(spark, csv):
    df = T.load_table(spark, csv, "n int, x string, flag string, word string, hole string")
    assert dict(df.dtypes)["n"] == "int" and df.count() == 3


def test_load_text_table_trims(spark, csv):
    assert {r["word"] for r in T.load_text_table(spark, csv).collect()} == {"a", "b", "n/a"}


def test_size_variants_and_head(spark):
    df = spark.range(1, 351).withColumnRenamed("id", "row_id")
    counts = {r["size"]: r["count"] for r in T.size_variants(df).groupBy("size").count().collect()}
    assert counts == {100: 100}
    assert T.head_rows(df, 10, "row_id").agg(F.max("row_id")).first()[0] == 10
    assert T.head_rows(df, 10).count() == 10


def test_size_variants_with_gaps_in_the_ids(spark):
    df = spark.range(50).selectExpr("10 * id + 10 as row_id")
    counts = {r["size"]: r["count"] for r in
              T.size_variants(df, (10, 20, 100)).groupBy("size").count().collect()}
    assert counts == {10: 10, 20: 20}
    assert T.size_variants(df, (100,)).count() == 0


def test_quoted_cells(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('n,word,x\n1,"a ""b"", c",3\n2,"two\nlines",4\n')
    rows = T.load_table(spark, str(path), line_breaks=True).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b", c', 3), (2, "two\nlines", 4)]
    path.write_text('n,word,x\n1,"a ""b"", c",3\n')
    assert tuple(T.load_table(spark, str(path)).first()) == (1, 'a "b", c', 3)
    assert T.load_text_table(spark, str(path)).first()["word"] == 'a "b", c'
    T.save_table(T.load_table(spark, str(path)), str(tmp_path / "back"), "csv")
    assert tuple(T.load_table(spark, str(tmp_path / "back"), fmt="csv").first()) == (1, 'a "b", c', 3)


def test_several_profiles_round_trip(spark, tmp_path):
    df = spark.range(1, 61).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("y"))
    rows = profile_all({"a": df, "b": df, "c": df}).drop("position")
    T.save_profile(rows.coalesce(1), str(tmp_path / "p"))
    assert T.load_profile(spark, str(tmp_path / "p")).count() == 6


def test_records_on_lines(spark, tmp_path):
    record = {"model": "m", "template_id": "a_v0", "model_answer": "x"}
    lines = [json.dumps({**record, "model_answer": str(i)}) for i in range(10)]
    (tmp_path / "eval_lines.json").write_text("\n".join(lines))
    rows = T.load_records(spark, str(tmp_path / "eval_lines.json"))
    assert {r["model_answer"] for r in rows.collect()} == {str(i) for i in range(10)}
    T.split_results(rows, str(tmp_path / "s"))
    back = T.load_records(spark, str(tmp_path / "s"))
    assert back.count() == 10
    (tmp_path / "eval_spread.json").write_text(json.dumps([record] * 4, indent=2))
    assert T.load_records(spark, str(tmp_path / "eval_spread.json"), spread_arrays=True).count() == 4


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_save_table(spark, tmp_path, fmt):
    T.save_table(spark.range(5), str(tmp_path / "t"), fmt)
    reader = spark.read.option("header", True).format(fmt)
    assert reader.load(str(tmp_path / "t")).count() == 5


def test_profile_round_trip(spark, tmp_path):
    df = spark.range(1, 61).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("y"))
    rows = profile(df, "d").drop("position")
    path = str(tmp_path / "p")
    T.save_profile(rows, path)
    T.save_profile(rows.limit(0), path)
    back = T.load_profile(spark, path)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.select(back.columns).collect()}


def test_records_are_tagged_and_split(spark, tmp_path):
    record = {
        "model": "m", "template_id": "a_v0", "dataset": "d_100", "model_answer": "x",
        "expected_answer": ["p", "q"], "metrics": {"input_tokens": 3},
        "tool_use": [{"tool": "t", "input": {"component": "overview"}}, {"tool": "t", "input": "code"}],
    }
    (tmp_path / "eval_blind.json").write_text(json.dumps([record, {**record, "template_id": "b_v0"}]))
    (tmp_path / "eval_tools.json").write_text(json.dumps([record]))
    rows = T.load_records(spark, [str(tmp_path / "eval_blind.json"), str(tmp_path / "eval_tools.json")])
    assert sorted(r["run"] for r in rows.collect()) == ["blind", "blind", "tools"]
    first = rows.first()
    assert json.loads(first["expected_answer"]) == ["p", "q"]
    assert json.loads(first["tool_use"][0]["input"]) == {"component": "overview"}
    assert first["tool_use"][1]["input"] == "code"
    counts = {r["template_id"]: r["records"] for r in T.split_results(rows, str(tmp_path / "s")).collect()}
    assert counts == {"a_v0": 2, "b_v0": 1}
    assert spark.read.json(str(tmp_path / "s")).groupBy("template_id").count().count() == 2


def test_rows_of_text_files_are_numbered_by_block(spark, tmp_path, monkeypatch):
    from tabprobe.operators import columns as C

    for f in range(3):
        with open(tmp_path / f"{f}.csv", "w") as out:
            out.write("a,b\n")
            out.writelines(f"k{f * 1000 + i},x{i % 7}\n" for i in range(1000))
    (tmp_path / "9.csv").write_text("a,b\n")

    def never(df):
        assert "b" not in df.columns, "the table was copied"
        return real(df)

    real = C.cut
    monkeypatch.setattr(C, "cut", never)
    found = []
    for size in ("3000", "900", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            table = C.ensure_row_id(T.load_table(spark, str(tmp_path), "a string, b string", "csv"))
            found.append(sorted((r["row_id"], r["a"], r["b"]) for r in table.collect()))
            assert sorted((r["row_id"], r["a"], r["b"]) for r in table.collect()) == found[-1]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(i + 1, f"k{i}", f"x{i % 1000 % 7}") for i in range(3000)]
    assert all(rows == want for rows in found)


def test_ids_far_apart_make_ranges_of_like_size(spark):
    from tabprobe.operators import columns as C

    ids = [*range(20_000), 10**15, -(10**12)]
    df = spark.createDataFrame([(i, float(i), float(i % 5), None) for i in ids],
                               "row_id long, up double, wave double, none double")
    df = df.repartition(7)
    assert C.has_inversion(df, ["up", "wave", "none"], "row_id") == {
        "up": False, "wave": True, "none": False}
    last = df.withColumn("up", F.when(F.col("row_id") == 10**15, -1.0).otherwise(F.col("up")))
    assert C.has_inversion(last, ["up"], "row_id") == {"up": True}
    dealt = df.repartitionByRange(8, "row_id").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in dealt.collect())
    assert sizes[-1] <= 4 * sizes[len(sizes) // 2]
    rows = df.select(F.lit("g").alias("g"), "row_id", "up", "wave")
    found = C.falls_along(rows, "g", ["row_id"], ["up", "wave"], 30_000_000).first()
    assert (found["up"], found["wave"]) == (False, True)
