"""Sinks: CSV and Parquet exports of the classified table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> str:
    """UTF-8 CSV with a header, no index column (one part file per task).
    Values are written as they are: Spark's writer would otherwise trim
    leading and trailing whitespace. Quotes inside a value are doubled, as CSV
    readers expect, and backslashes are plain characters."""
    (df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_export_csv(spark, path: str, schema):
    """Read an ``export_csv`` result back with its schema. The writer puts
    null as an empty field and '' as a quoted empty field; a null marker that
    never occurs keeps the two apart on reading."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "")
            .csv(path))


def export_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Snappy-compressed Parquet."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def register_view(df: DataFrame, name: str = "transcripts") -> DataFrame:
    """Expose a result to SQL (``spark.sql('... FROM transcripts')``)."""
    df.createOrReplaceTempView(name)
    return df
