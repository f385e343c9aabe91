"""Pipe-delimited text without a header, each line ending in a delimiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pipe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a ``|``-separated file or folder.

    Fields are trimmed and an empty one is NULL; blank lines are skipped. Quotes are ordinary
    characters. A value that its column's type can't hold fails the read once it is used. A row
    with fewer fields has NULL in the rest, further fields are ignored. Large files are split
    among tasks.
    """
    tail = "__after_last"
    padded = T.StructType([*schema.fields, T.StructField(tail, T.StringType())])
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in padded.fields]))
    raw = raw.option("sep", "|").option("quote", "").option("nullValue", "").option("mode", "PERMISSIVE")
    raw = raw.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    # a cast raises on a bad value, as the reader's FAILFAST mode does, which rejects short rows too
    return raw.select(*[raw[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def write_pipe(df: DataFrame, path: str) -> None:
    """Rows as ``read_pipe`` reads them: a delimiter after each field, NULL as nothing."""
    field = lambda c: F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"))
    df.select(F.concat(*[field(c) for c in df.columns]).alias("value")).write.text(path)
