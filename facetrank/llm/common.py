"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_path, ship_package

# Words are runs of anything but these six characters (space, and tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def ready(spark: SparkSession) -> None:
    """Set the shared folder if unset and put the package on the workers' path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ready(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A table of literals, made inside the plan (no Python rows reach an executor)."""
    rows = list(rows)
    ddl = "array<struct<" + ",".join(f"{n}:{t}" for n, t in schema) + ">>"
    cells = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, schema, strict=True)]) for r in rows]
    arr = F.array(*cells).cast(ddl) if cells else F.lit(None).cast(ddl)
    return spark.range(1).select(F.explode(arr).alias("r")).select("r.*")


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null or blank texts."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+", -1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it.

    A filter that the optimizer moves below a projection carries whole expressions with it; names
    bound this way are not copied into each use.
    """
    return F.transform(F.array(value), body)[0]


def prefix_fold(arr: Column, op, block: int = 512) -> Column:
    """Exclusive prefix sums (or maxima) of an array of longs from 0, as an expression.

    ``op`` is associative.  Folding with ``concat`` copies the result at every step, so the array is
    cut into blocks: running values inside a block, then running values over the block totals.
    """
    zero = F.lit(0).cast("long")

    def running(a: Column) -> Column:
        return F.aggregate(
            a, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct(op(acc["at"], x).alias("at"),
                                    F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    n = F.size(arr)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(block))).otherwise(
        F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda s: F.slice(arr, s, block))
    return F.when(n <= block, running(arr)).otherwise(F.flatten(F.zip_with(
        running(F.transform(blocks, lambda b: F.aggregate(b, zero, op))), F.transform(blocks, running),
        lambda before, inner: F.transform(inner, lambda v: op(before, v)))))


def prefix_sums(arr: Column) -> Column:
    return prefix_fold(arr, lambda a, b: a + b)


def prefix_max(arr: Column) -> Column:
    return prefix_fold(arr, lambda a, b: F.greatest(a, b))
