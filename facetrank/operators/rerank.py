"""Pairwise rescoring of (query, chunk) candidates.

The whole query text is scored against each candidate chunk, whatever the
aspect.  The default scorer is model-free and JVM-side: the share of the
query's distinct tokens found among the chunk's tokens (0..1).  A custom
scorer (for instance a cross-encoder) is a Python callable
``scorer(queries: pd.Series, texts: pd.Series) -> pd.Series`` run in an
iterator pandas UDF, so the model is loaded once per Python worker and fed
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import rank_within, tokens

PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def coverage(query: Column | str, text: Column | str) -> Column:
    q = F.array_distinct(tokens(query))
    t = F.array_distinct(tokens(text))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, t)).cast("double") / F.size(q))


def pandas_scorer(scorer: PairScorer):
    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in it:
            yield pd.Series(scorer(q.fillna(""), t.fillna("")), dtype="float64").reset_index(drop=True)
    return score


def jaccard_scorer(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A custom scorer: shared tokens over all tokens of the pair."""
    pairs = [(set(q.split()), set(t.split())) for q, t in zip(queries, texts, strict=True)]
    return pd.Series([len(q & t) / len(q | t) if q | t else 0.0 for q, t in pairs])


def rerank(candidates: DataFrame, queries: DataFrame, scorer: PairScorer | None = None) -> DataFrame:
    """Adds cross_score and rerank_pos (1-based per query, score desc, doc_id)."""
    pairs = candidates.join(queries.select("query_id", "query"), "query_id")
    if scorer is None:
        scored = pairs.withColumn("cross_score", coverage("query", "text"))
    else:
        scored = pairs.withColumn("cross_score", pandas_scorer(scorer)(F.col("query"), F.col("text")))
    return rank_within(scored.drop("query"), ["query_id"], "cross_score", "doc_id", None, "rerank_pos")


def snippet(text: Column | str, length: int = 50) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, length)


def rerank_report(reranked: DataFrame) -> DataFrame:
    """Rerank log: query_id, rerank_pos, hall_id, hall_name, aspect, cross_score (%.4f), and the whole text."""
    return reranked.select(
        "query_id", "rerank_pos", "hall_id", "hall_name", "aspect",
        F.format_string("%.4f", F.round("cross_score", 4)).alias("cross_score"), "text")
