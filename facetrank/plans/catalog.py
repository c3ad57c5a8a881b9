"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full.  Scores are rounded (6 places, rrf 8) so that results compare across
engines; ranks are taken on 9 places with an id tiebreak.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense, fusion, intent, lexical, metrics, postings, rerank, rollup
from ..sources import fixtures as fx
from . import two_stage as ts

Query = Callable[[SparkSession, str], DataFrame]


def _r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def q_bm25_stats(spark, sf):
    terms, aspects = lexical.term_stats(fx.chunks(spark, sf), lexical.build_index(fx.chunks(spark, sf)))
    return terms.join(F.broadcast(aspects.select("aspect", "n_docs", "avgdl")), "aspect").select(
        "aspect", "term", "df", _r6("idf"), "n_docs", _r6("avgdl"))


def q_bm25_topk(spark, sf):
    q = fx.queries(spark, sf)
    qa = lexical.all_aspects(q, fx.DOCUMENT_ASPECTS)
    return lexical.bm25_topk(fx.chunks(spark, sf), q, qa).select(
        "query_id", "aspect", "doc_id", _r6("score"), "rank")


def q_bm25_topk_stored(spark, sf):
    q = fx.queries(spark, sf)
    qa = lexical.all_aspects(q, fx.DOCUMENT_ASPECTS)
    index = postings.load(spark, postings.store(fx.chunks(spark, sf)))
    return postings.search(index, q, qa).ranked.select("query_id", "aspect", "doc_id", _r6("score"), "rank")


def q_dense_topk(spark, sf):
    return dense.dense_topk(fx.vectors(spark, sf), fx.query_vectors(spark, sf)).select(
        "query_id", "aspect", "doc_id", _r6("sim"), "rank")


def _fused_cols(df: DataFrame) -> DataFrame:
    return df.select("query_id", "aspect", "doc_id", "hall_id", "d_rank", "s_rank",
                     F.round("rrf_score", 8).alias("rrf_score"), "rrf_rank")


def q_rrf(spark, sf):
    inp = ts.Inputs.from_sf(spark, sf)
    qa = lexical.all_aspects(inp.queries, inp.aspect_order)
    return _fused_cols(ts.hybrid_candidates(inp, qa))


def q_intent_aspects(spark, sf):
    inp = ts.Inputs.from_sf(spark, sf)
    kept, counts = ts.asked_aspects(inp)
    return kept.join(counts, "query_id").select("query_id", "aspect", _r6("score"), "n_aspects")


def q_hybrid_candidates(spark, sf):
    inp = ts.Inputs.from_sf(spark, sf)
    kept, _ = ts.asked_aspects(inp)
    return _fused_cols(ts.hybrid_candidates(inp, kept))


def _pipe(spark, sf):
    inp = ts.Inputs.from_sf(spark, sf)
    return inp, ts.run(inp)


def q_rerank(spark, sf):
    _, r = _pipe(spark, sf)
    return r.reranked.select("query_id", "aspect", "doc_id", "hall_id", _r6("cross_score"), "rerank_pos")


def q_rerank_report(spark, sf):
    _, r = _pipe(spark, sf)
    return rerank.rerank_report(r.reranked)


def q_soft_weight_rollup(spark, sf):
    _, r = _pipe(spark, sf)
    return r.rollup.select("query_id", "hall_id", _r6("base_score"), "n_found", _r6("total_score"))


def q_step_weight_rollup(spark, sf):
    _, r = _pipe(spark, sf)
    return rollup.step_weight_rollup(r.reranked).select(
        "query_id", "hall_id", _r6("base_score"), "n_found", _r6("total_score"))


def q_final_report(spark, sf):
    inp, r = _pipe(spark, sf)
    return rollup.final_report(r.rollup, inp.venues)


def q_two_stage_rank(spark, sf):
    inp, r = _pipe(spark, sf)
    return ts.ranked_with_gold(inp, r)


def q_eval_recall(spark, sf):
    inp, r = _pipe(spark, sf)
    rec, _ = ts.evaluate(inp, r)
    return rec.select("query_id", "n_gold", "n_found", _r6("recall"))


def q_eval_metrics(spark, sf):
    inp, r = _pipe(spark, sf)
    _, m = ts.evaluate(inp, r)
    return m.select("query_id", "n_gold", _r6("mrr"), _r6("mrr_first"), "hit_rate", _r6("ndcg"))


CORE: dict[str, Query] = {
    "bm25_stats": q_bm25_stats,
    "bm25_topk": q_bm25_topk,
    "bm25_topk_stored": q_bm25_topk_stored,
    "dense_topk": q_dense_topk,
    "rrf": q_rrf,
    "intent_aspects": q_intent_aspects,
    "hybrid_candidates": q_hybrid_candidates,
    "rerank": q_rerank,
    "rerank_report": q_rerank_report,
    "soft_weight_rollup": q_soft_weight_rollup,
    "step_weight_rollup": q_step_weight_rollup,
    "final_report": q_final_report,
    "two_stage_rank": q_two_stage_rank,
    "eval_recall": q_eval_recall,
    "eval_metrics": q_eval_metrics,
}


def all_queries() -> dict[str, Query]:
    from . import board_queries, score_queries, text_queries, vector_queries
    out = dict(CORE)
    for reg in (text_queries.REGISTRY, score_queries.REGISTRY, vector_queries.REGISTRY, board_queries.REGISTRY):
        out.update({k: fn for k, (fn, _) in reg.items()})
    return out
