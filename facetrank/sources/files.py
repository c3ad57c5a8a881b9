"""CSV and Parquet sources and sinks.

Texts hold commas, quotes and newlines, so CSV is written and read with
``multiLine`` and RFC quoting (a quote inside a field is doubled), with
leading and trailing blanks kept.  Schemas are always explicit; nothing is
inferred.  Tables are written under the shared folder named by
``spark.checkpoint.dir`` (see ``session.shared_path``), never a local one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_path

CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}

RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("hall_name", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("written_days", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("full_text", T.StringType()),
])

ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
])

VECTOR_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_key", T.StringType()),
    T.StructField("venue_id", T.LongType()),
    T.StructField("hall_name", T.StringType()),
    T.StructField("text_chunk", T.StringType()),
    T.StructField("vector", T.ArrayType(T.DoubleType())),
    T.StructField("aspect", T.StringType()),
])


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite", bom: bool = False) -> None:
    """``bom``: every file starts with a UTF-8 byte order mark (before the first column's name)."""
    if bom and header:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    w = df.write.mode(mode).option("header", str(header).lower())
    for k, v in CSV_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    r = spark.read.schema(schema).option("header", str(header).lower())
    for k, v in CSV_OPTIONS.items():
        r = r.option(k, v)
    return r.csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows without a header (the crawler's per-article sink)."""
    write_csv(df, path, header=False, mode="append")


def write_vectors(df: DataFrame, path: str) -> None:
    """Long vector table partitioned by aspect, so an aspect filter prunes files."""
    df.write.mode("overwrite").partitionBy("aspect").parquet(path)


def read_vectors(spark: SparkSession, path: str, schema: T.StructType = VECTOR_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once under the shared folder: readers' plans begin at the files."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
