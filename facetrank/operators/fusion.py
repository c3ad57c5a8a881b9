"""Reciprocal rank fusion of the dense and the BM25 rank lists, per aspect.

``rrf = 1/(k + dense_rank) + 1/(k + bm25_rank)`` where a rank missing from one
list counts as ``missing_rank`` (100), so a chunk found by one list only still
scores ``1/(k + r) + 1/(k + 100)``.  Fusion never crosses aspects.  Chunks
absent from the chunk table are dropped (inner join); the top-n is cut by
rrf descending, then doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import RETRIEVAL_TOP_N, RRF_K, RRF_MISSING_RANK
from .lexical import rank_within

KEYS = ["query_id", "aspect", "doc_id"]


def rrf_score(d_rank: str = "d_rank", s_rank: str = "s_rank", k: int = RRF_K,
              missing: int = RRF_MISSING_RANK):
    return (F.lit(1.0) / (F.lit(k) + F.coalesce(F.col(d_rank), F.lit(missing)))
            + F.lit(1.0) / (F.lit(k) + F.coalesce(F.col(s_rank), F.lit(missing))))


def rrf(dense_ranks: DataFrame, sparse_ranks: DataFrame, chunks: DataFrame,
        k: int = RRF_K, missing: int = RRF_MISSING_RANK, n: int = RETRIEVAL_TOP_N) -> DataFrame:
    """query_id, aspect, doc_id, hall_id, hall_name, text, d_rank, s_rank, rrf_score, rrf_rank."""
    d = dense_ranks.select(*KEYS, F.col("rank").alias("d_rank"))
    s = sparse_ranks.select(*KEYS, F.col("rank").alias("s_rank"))
    fused = d.join(s, KEYS, "full_outer").withColumn("rrf_score", rrf_score(k=k, missing=missing))
    # the fused set holds at most 2n rows per query and aspect; whether it is broadcast is decided by its bytes at run time
    meta = chunks.select("doc_id", F.col("venue_id").alias("hall_id"), "hall_name",
                         F.col("aspect").alias("_chunk_aspect"), "text")
    joined = (meta.join(fused, "doc_id")
              .where(F.col("_chunk_aspect") == F.col("aspect")).drop("_chunk_aspect"))
    return rank_within(joined, ["query_id", "aspect"], "rrf_score", "doc_id", n, "rrf_rank")
