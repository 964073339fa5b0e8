"""Reading input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PRICE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("feature1", T.DoubleType()),
        T.StructField("feature2", T.DoubleType()),
        T.StructField("feature3", T.DoubleType()),
        T.StructField("category_feature", T.StringType()),
    ]
)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by suffix, anything else as CSV with a header.

    Give ``schema`` for CSV at scale: without one Spark reads the files an
    extra time to infer it.
    """
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def load_reference(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A drift reference window; only ``.csv`` and ``.parquet`` are accepted."""
    if not path.rstrip("/").endswith((".csv", ".parquet")):
        raise ValueError(f"unsupported reference file: {path}")
    return load_table(spark, path, schema)
