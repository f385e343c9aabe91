"""The façade: register tables, run SQL, get DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schemas import TABLES, schema_of
from .sources import read_table


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Engine:
    """SQL over named tables of one Spark session; parsing, planning and execution are Spark's."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()

    def load_table(self, name: str, path: str, schema: Iterable[tuple[str, str]] | T.StructType | None = None) -> DataFrame:
        """Register ``path`` as ``name``, in place of any table of that name.

        The schema is the given one ((column, type) pairs or a StructType), else that of the
        decision-support table of this name; Parquet brings its own.
        """
        if schema is not None and not isinstance(schema, T.StructType):
            schema = schema_of(schema)
        if schema is None and not path.rstrip("/").endswith(".parquet"):
            if name not in TABLES:
                raise ValueError(f"table {name!r} is not known and no schema is given")
            schema = TABLES[name]
        df = read_table(self.spark, path, schema)
        df.createOrReplaceTempView(name)
        return df

    def load_tpch(self, folder: str, tables: Iterable[str] | None = None) -> list[str]:
        """Register ``<table>.tbl`` or ``<table>.parquet`` of all tables, or the given ones; missing files are left out."""
        found = []
        for name in tables if tables is not None else TABLES:
            for path in (f"{folder}/{name}.tbl", f"{folder}/{name}.parquet"):
                if exists(self.spark, path):
                    self.load_table(name, path)
                    found.append(name)
                    break
        return found

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def execute(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    @staticmethod
    def to_dicts(df: DataFrame, limit: int = 100_000) -> list[dict]:
        """A small result as dicts; more rows than ``limit`` are an error, not a longer list."""
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rows; write the DataFrame instead")
        return [r.asDict() for r in rows]
