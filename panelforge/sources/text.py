"""Typed CSV sources and sinks (the reference's inputs are CSV files).

The reference reads CSV with a header and no schema, so every column arrives
as a string and is cast later.  We read with an explicit schema instead (no
inference pass over the data), or read everything as strings and cast in one
projection with ``cast_columns``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PANEL_SCHEMA = T.StructType([
    T.StructField("series", T.LongType()),
    T.StructField("county", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("t", T.DateType()),
    T.StructField("active", T.IntegerType()),
    T.StructField("density", T.DoubleType()),
])

FUTURE_SCHEMA = T.StructType([
    T.StructField("series", T.LongType()),
    T.StructField("t", T.DateType()),
])


def string_schema(schema: T.StructType) -> T.StructType:
    """The same column names with every type replaced by STRING."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             header: bool = True, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV scan.  With ``schema=None`` every column is read as a string, the
    way the reference loads its files; otherwise the schema is enforced at
    read time and malformed fields become NULL (PERMISSIVE mode)."""
    reader = (spark.read.option("header", header).option("mode", "PERMISSIVE")
              .option("dateFormat", date_format))
    if schema is None:
        return reader.option("inferSchema", False).csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True,
              date_format: str = "yyyy-MM-dd") -> str:
    """Write a DataFrame as CSV (one file per partition) and return the path."""
    (df.write.mode("errorifexists").option("header", header)
     .option("dateFormat", date_format).csv(path))
    return path
