"""File sources and sinks: CSV, JSON documents, Parquet, and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.functions.scalars import finite


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are declared, or inferred for a look at an unknown file.

    NaN and infinities are read as null, and the index column that some writers add is left out.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    df = df.drop("Unnamed: 0", "_c0")
    return df.withColumns({f.name: finite(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_documents(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """One nested document a file; absent fields are null; ``source_file`` says where a row is from."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("source_file", F.input_file_name())


def describe_schema(df: DataFrame) -> DataFrame:
    """column and type of every column, as rows."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sets(df: DataFrame, path: str, by: str) -> None:
    """Parquet, one folder a value of ``by`` (a split, a label set, a year)."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def score_new(spark: SparkSession, path: str, card: DataFrame) -> DataFrame:
    """A saved model over new rows; nothing is fitted again."""
    return PipelineModel.load(path).transform(card)


def query_table(df: DataFrame, name: str, sql: str) -> DataFrame:
    """Registers the table and runs SQL over it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)
