"""Named tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import safe_divide, whole_cents
from .delimited import read_pipe


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet by its suffix, else pipe-delimited text, for which a schema is needed."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    if schema is None:
        raise ValueError(f"no schema for {path}")
    return read_pipe(spark, path, schema)


class Tables:
    """``Tables(spark, folder).lineitem`` is the DataFrame over ``folder/lineitem.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @property
    def partsupp(self) -> DataFrame:
        """What each supplier has delivered of each part, which stands in for stock and cost."""
        unit = safe_divide(F.col("l_extendedprice"), F.col("l_quantity"))
        return self.lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
            F.sum("l_quantity").alias("ps_availqty"), whole_cents(F.min(unit)).alias("ps_supplycost")
        )
