"""Upsert of keyed rows: as one DataFrame, and into a stored table of which only the touched buckets are rewritten.

The winner of a key is the row with the highest version; of equal versions the row of the later load; inside one load the
row with the highest hash of all its columns.  So a load that is merged again changes nothing.

A stored table is Parquet, partitioned by ``bucket``, a hash of the key into a fixed number of buckets.  A load reads and
rewrites only the buckets that its keys fall in (partition pruning, then a dynamic partition overwrite); the others
are neither read nor shuffled.  Old and new rows of a bucket meet by one shuffle on the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_path


def _winners(both: DataFrame, within: list[str], keys: list[str], version: str, columns: list[str]) -> DataFrame:
    order = [F.col(version).desc(), F.col("_load").desc(), F.xxhash64(*[F.col(c) for c in columns]).desc()]
    rank = F.row_number().over(Window.partitionBy(*within, *keys).orderBy(*order))
    return both.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_load")


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id", version: str = "version") -> DataFrame:
    """Old and new rows with one row a key."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    return _winners(both, [], [key], version, old.columns)


class KeyedTable:
    """A table at ``path`` with one row a key; ``schema`` is that of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], version: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path, keys, version, buckets
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
        self.columns = [f.name for f in schema.fields]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _stored(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        return self.spark.read.schema(whole).parquet(self.path)

    def create(self, rows: DataFrame | None = None) -> "KeyedTable":
        """A new table of ``rows`` (none by default).  What is at the path is overwritten."""
        empty = self.spark.createDataFrame([], self.schema)
        rows = (empty if rows is None else rows).select(*self.columns).withColumn("bucket", self._bucket())
        rows = _winners(rows.repartition("bucket").withColumn("_load", F.lit(0)), ["bucket"], self.keys, self.version, self.columns)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self.path)
        return self

    def merge(self, new: DataFrame) -> list[int]:
        """Merge a load; returns the buckets it rewrote."""
        staged = shared_path(self.spark, "upsert-load")
        new.select(*self.columns).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(staged)
        load = self.spark.read.schema(self._stored().schema).parquet(staged)
        touched = sorted(r["bucket"] for r in load.select("bucket").distinct().collect())     # at most the number of buckets
        if not touched:
            return []
        old = self._stored().where(F.col("bucket").isin(touched)).withColumn("_load", F.lit(0))
        both = old.unionByName(load.withColumn("_load", F.lit(1))).repartition("bucket")
        merged = shared_path(self.spark, "upsert-merged")
        _winners(both, ["bucket"], self.keys, self.version, self.columns).write.partitionBy("bucket").parquet(merged)
        (self.spark.read.schema(self._stored().schema).parquet(merged).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path))
        return touched
