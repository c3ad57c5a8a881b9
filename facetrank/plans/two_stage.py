"""The two-stage flow as one lazily composed plan per stage.

intent -> hybrid retrieval (BM25 + dense, fused by RRF, per asked aspect)
-> rerank -> venue roll-up -> top 20 -> metrics.

The whole query batch goes through every stage together; nothing iterates
over queries or aspects on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import FINAL_TOP_N, RETRIEVAL_TOP_N
from ..operators import dense, encode, fusion, gold, intent, lexical, metrics, rerank, rollup
from ..session import shared_path
from ..sources import files
from ..sources import fixtures as fx
from .strategy import materialize_small


@dataclass
class Inputs:
    chunks: DataFrame
    chunk_vectors: DataFrame
    queries: DataFrame
    query_vectors: DataFrame
    venues: DataFrame
    aspect_order: list[str]
    _index: lexical.Bm25Index | None = None

    @property
    def index(self) -> lexical.Bm25Index:
        """BM25 postings and statistics, built once for the whole query batch."""
        if self._index is None:
            self._index = lexical.build_index(self.chunks, queries=self.queries)
        return self._index

    @classmethod
    def from_sf(cls, spark: SparkSession, sf_dir: str) -> "Inputs":
        chunks, queries = fx.chunks(spark, sf_dir), fx.queries(spark, sf_dir)
        return cls(chunks, chunk_index(chunks), queries, encode.encode_pooled(queries, "query", "query_id"),
                   fx.venues(spark, sf_dir), fx.DOCUMENT_ASPECTS)


def chunk_index(chunks: DataFrame) -> DataFrame:
    """The dense index: every chunk's pooled token vector, written once to the shared folder."""
    spark = chunks.sparkSession
    path = shared_path(spark, "chunk-index")
    files.write_vectors(encode.encode_pooled(chunks, keep=("aspect",)), path)
    return files.read_vectors(spark, path).select("doc_id", "aspect", "vector")


def hybrid_candidates(inp: Inputs, query_aspects: DataFrame, n: int = RETRIEVAL_TOP_N) -> DataFrame:
    sparse = lexical.bm25_topk(inp.chunks, inp.queries, query_aspects, n, index=inp.index)
    dense_ = dense.dense_topk(inp.chunk_vectors, inp.query_vectors, query_aspects, n)
    return fusion.rrf(dense_, sparse, inp.chunks, n=n)


def asked_aspects(inp: Inputs, intent_scorer=None) -> tuple[DataFrame, DataFrame]:
    scores = intent.vocabulary_scores(inp.chunks, inp.queries, inp.index.terms) if intent_scorer is None else \
        intent.scored(inp.queries, inp.aspect_order, intent_scorer)
    # bounded by queries x aspects; read by the BM25, dense and roll-up branches
    kept = materialize_small(intent.intent_aspects(scores, inp.aspect_order))
    return kept, materialize_small(intent.aspect_counts(inp.queries, kept))


@dataclass
class TwoStage:
    kept: DataFrame
    counts: DataFrame
    candidates: DataFrame
    reranked: DataFrame
    rollup: DataFrame
    top: DataFrame


def run(inp: Inputs, scorer=None, n: int = RETRIEVAL_TOP_N, top_n: int = FINAL_TOP_N, intent_scorer=None) -> TwoStage:
    kept, counts = asked_aspects(inp, intent_scorer)
    cands = hybrid_candidates(inp, kept, n)
    rr = rerank.rerank(cands, inp.queries, scorer)
    roll = rollup.soft_weight_rollup(rr, counts)
    top = rollup.top_venues(roll, top_n)
    return TwoStage(kept, counts, cands, rr, roll, top)


def gold_set(inp: Inputs) -> DataFrame:
    return gold.substring_gold(inp.chunks, inp.queries)


def evaluate(inp: Inputs, ts: TwoStage) -> tuple[DataFrame, DataFrame]:
    g = gold_set(inp)
    return (metrics.recall(inp.queries, g, ts.candidates),
            metrics.ranking_metrics(inp.queries, g, ts.top))


def ranked_with_gold(inp: Inputs, ts: TwoStage) -> DataFrame:
    g = gold_set(inp).withColumn("is_gold", F.lit(True))
    return (ts.top.join(g, ["query_id", "hall_id"], "left")
            .select("query_id", "rank", "hall_id", F.round("total_score", 6).alias("total_score"),
                    F.coalesce("is_gold", F.lit(False)).alias("is_gold")))
