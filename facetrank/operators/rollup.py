"""Roll chunk scores up to venues, rank venues, write the final report.

Soft weight: ``sum over aspects of the best chunk score x (1 + found / N)``
where ``found`` counts the aspects with any candidate for the venue and N is
the number of aspects the query asked for.  Step weight (older rule):
``x 0.5`` with fewer than two aspects, else ``x 1.5``.

Two aggregations, both with partial (map-side) aggregation; the second reuses
the first one's hash partitioning on (query_id, hall_id), so it adds no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FINAL_TOP_N
from .lexical import rank_within


def _per_venue(reranked: DataFrame) -> DataFrame:
    best = (reranked.groupBy("query_id", "hall_id", "aspect")
            .agg(F.max("cross_score").alias("best")))
    return (best.groupBy("query_id", "hall_id")
            .agg(F.sum("best").alias("base_score"), F.count(F.lit(1)).alias("n_found")))


def soft_weight_rollup(reranked: DataFrame, n_aspects: DataFrame) -> DataFrame:
    """query_id, hall_id, base_score, n_found, total_score.

    ``n_aspects`` has one row per query (query_id, n_aspects); queries with
    N < 1 give no rows.
    """
    v = _per_venue(reranked).join(n_aspects.select("query_id", "n_aspects"), "query_id")
    return (v.where(F.col("n_aspects") >= 1)
            .withColumn("total_score", F.col("base_score")
                        * (F.lit(1.0) + F.col("n_found") / F.col("n_aspects")))
            .drop("n_aspects"))


def step_weight_rollup(reranked: DataFrame) -> DataFrame:
    v = _per_venue(reranked)
    return v.withColumn("total_score", F.col("base_score")
                        * F.when(F.col("n_found") < 2, F.lit(0.5)).otherwise(F.lit(1.5)))


def top_venues(rollup: DataFrame, n: int = FINAL_TOP_N) -> DataFrame:
    """query_id, hall_id, total_score, rank (total desc, hall_id asc), rank <= n."""
    return rank_within(rollup.select("query_id", "hall_id", "total_score"),
                       ["query_id"], "total_score", "hall_id", n)


def final_report(rollup: DataFrame, venues: DataFrame, n: int = FINAL_TOP_N) -> DataFrame:
    """rank, query_id, hall_id, hall_name ('Unknown' if absent), total_score (4 places)."""
    top = top_venues(rollup, n)
    names = venues.select(F.col("venue_id").alias("hall_id"), "hall_name")
    return (top.join(names, "hall_id", "left")
            .select("query_id", "rank", "hall_id",
                    F.coalesce("hall_name", F.lit("Unknown")).alias("hall_name"),
                    F.round("total_score", 4).alias("total_score")))


def write_report(report: DataFrame, path: str) -> None:
    """Report sink (rerank log, final ranking): CSV with a header, texts quoted.

    Scores are already fixed to 4 places by the report builders.  ``path``
    should be under the shared folder (``session.shared_path``)."""
    from ..sources.files import write_csv
    write_csv(report, path, header=True, bom=True)
