"""Files written and read back, saved models, and the streaming count."""

import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import types as T

from strideline.sources import files
from strideline.sources.scratch import Scratch, begun, shared_dir
from strideline.streaming.counts import tumbling_counts


def test_csv_round_trip_and_missing_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5), (2, float("inf")), (3, float("nan"))], "a int, b double")
    files.write_csv(df, f"{tmp_path}/x")
    back = files.read_csv(spark, f"{tmp_path}/x", df.schema)
    assert sorted((r["a"], r["b"]) for r in back.collect() if r["b"] is not None) == [(1, 1.5)]
    assert files.read_csv(spark, f"{tmp_path}/x").count() == 3
    assert files.describe_schema(df).collect()[1]["type"] == "double"


def test_documents_with_absent_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "1", "details": {"age": "3"}, "records": [{"x": 1}]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "2"}))
    schema = T._parse_datatype_string("id string, details struct<age:string,sex:string>, records array<struct<x:int>>")
    rows = {r["id"]: r for r in files.read_documents(spark, f"{tmp_path}/*.json", schema).collect()}
    assert rows["1"]["details"]["sex"] is None and rows["2"]["records"] is None and rows["2"]["source_file"].endswith("b.json")


def test_saved_model_scores_a_new_card(spark, tmp_path):
    df = spark.createDataFrame([(float(x), 2.0 * x) for x in range(20)], "x double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression()]).fit(df)
    files.save_model(model, f"{tmp_path}/m")
    assert abs(files.score_new(spark, f"{tmp_path}/m", df.limit(1)).first()["prediction"]) < 1e-6
    files.write_sets(df.withColumn("label", df.label > 10), f"{tmp_path}/s", "label")
    assert spark.read.parquet(f"{tmp_path}/s").filter("label = 'true'").count() == 14
    assert files.query_table(df, "card", "select count(*) n from card").first()["n"] == 20


def test_scratch_reads_back_and_drops(spark):
    scratch = Scratch(spark, "t")
    assert scratch.save(spark.range(5), "a").count() == 5 and scratch.save(spark.range(0), "b").count() == 0
    assert scratch.base.startswith(shared_dir(spark))
    scratch.drop("a", "b", "never")


def test_streaming_counts(spark, tmp_path):
    df = spark.sql("select id % 3 as k, timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int) * 20) as ts from range(30)")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = tumbling_counts(stream, "k", "ts", 168).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) s from counts").first()["s"] == 30


def test_begun_lists_the_jobs_that_begin_inside(spark):
    before = Scratch(spark, "before")
    with begun() as outer:
        a = Scratch(spark, "a")
        with begun() as inner:
            b = Scratch(spark, "b")
    assert outer == [a] and inner == [b] and before not in outer
    rows = b.save(spark.range(3), "rows")
    assert any(b.name in path for path in rows.inputFiles())
