"""Tables that grow: the same SQL and DataFrame queries over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_table(spark: SparkSession, name: str, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Register the Parquet files that arrive in ``folder`` as the streaming table ``name``."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    df.createOrReplaceTempView(name)
    return df
