"""Retrieval and ranking metrics per query.

recall    gold venues found among the candidates (before reranking) / gold
mrr       sum of 1/rank over all gold venues in the top-20 / gold (not the
          first-hit textbook form, which is ``mrr_first``)
hit_rate  1 if any gold venue is in the top-k (k=10)
ndcg      binary-gain DCG@k / ideal DCG over min(gold, k)
An empty gold set gives zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import METRIC_K


def _ideal_dcg(g: Column, k: int) -> Column:
    m = F.least(g, F.lit(k))
    series = F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                         lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))
    return F.when(m > 0, series).otherwise(F.lit(0.0))


def recall(queries: DataFrame, gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, n_gold, n_found, recall."""
    found = candidates.select("query_id", "hall_id").distinct()
    g = gold.select("query_id", "hall_id").distinct()
    hits = g.join(found, ["query_id", "hall_id"], "left_semi").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_found"))
    n_gold = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    out = (queries.select("query_id").join(n_gold, "query_id", "left").join(hits, "query_id", "left")
           .select("query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
                   F.coalesce("n_found", F.lit(0)).alias("n_found")))
    return out.withColumn("recall", F.when(F.col("n_gold") > 0, F.col("n_found") / F.col("n_gold"))
                          .otherwise(F.lit(0.0)))


def ranking_metrics(queries: DataFrame, gold: DataFrame, ranking: DataFrame,
                    k: int = METRIC_K) -> DataFrame:
    """query_id, n_gold, mrr, mrr_first, hit_rate, ndcg from a ranking (query_id, hall_id, rank)."""
    g = gold.select("query_id", "hall_id").distinct()
    ranked = g.join(ranking.select("query_id", "hall_id", "rank"), ["query_id", "hall_id"], "left")
    per_q = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_gold"),
        F.sum(F.when(F.col("rank").isNotNull(), F.lit(1.0) / F.col("rank")).otherwise(F.lit(0.0))).alias("rr_sum"),
        F.min("rank").alias("first_rank"),
        F.max(F.when(F.col("rank") <= k, F.lit(1)).otherwise(F.lit(0))).alias("hit"),
        F.sum(F.when(F.col("rank") <= k, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1)))
              .otherwise(F.lit(0.0))).alias("dcg"))
    out = queries.select("query_id").join(per_q, "query_id", "left")
    n = F.coalesce(F.col("n_gold"), F.lit(0))
    idcg = _ideal_dcg(n, k)
    return out.select(
        "query_id", n.alias("n_gold"),
        F.when(n > 0, F.col("rr_sum") / n).otherwise(F.lit(0.0)).alias("mrr"),
        F.when(F.col("first_rank").isNotNull(), F.lit(1.0) / F.col("first_rank")).otherwise(F.lit(0.0)).alias("mrr_first"),
        F.coalesce(F.col("hit"), F.lit(0)).cast("double").alias("hit_rate"),
        F.when(idcg > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / idcg).otherwise(F.lit(0.0)).alias("ndcg"))
