"""Physical choices that Catalyst cannot make on its own.

Join sides carry no hints: adaptive execution broadcasts a side once its bytes
are known, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def materialize_small(df: DataFrame) -> DataFrame:
    """Persist a bounded intermediate result (a query batch's aspects, counts) used by several branches."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


