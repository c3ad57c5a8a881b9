"""Multi-label query intent: which aspects a query asks about.

A score table (query_id, aspect, score) is cut at ``score > 0.5`` and to the
first 7 aspects of the aspect order; N = max(number kept, 1).  A query with
no aspect keeps N = 1 and gets no candidates.

The default scorer is model-free: the share of the query's distinct tokens
that occur in the aspect's vocabulary.  Only the query tokens are looked up:
the chunk tokens are semi-joined with the query-token set before the distinct
(aspect, term) aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import INTENT_LABEL_COUNT, INTENT_THRESHOLD
from .lexical import tokens


def vocabulary_scores(chunks: DataFrame, queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """query_id, aspect, score.  With ``known`` (aspect, term, ...: postings or term statistics) the corpus is not re-tokenised."""
    qtok = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term"))
    nq = qtok.groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    terms = qtok.select("term").distinct()
    words = (known.select("aspect", "term") if known is not None
             else chunks.select("aspect", F.explode(tokens("text")).alias("term")))
    vocab = words.join(terms, "term", "left_semi").distinct()
    hits = vocab.join(qtok, "term").groupBy("query_id", "aspect").agg(F.count(F.lit(1)).alias("nhit"))
    return hits.join(nq, "query_id").select("query_id", "aspect", (F.col("nhit") / F.col("nq")).alias("score"))


def scored(queries: DataFrame, aspects: list[str], scorer: Callable[[pd.Series, list[str]], np.ndarray]) -> DataFrame:
    """query_id, aspect, score by a pluggable multi-label scorer: ``scorer(queries, aspects) -> n x aspects array``, called
    once an Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = np.asarray(scorer(pdf["query"].fillna(""), aspects), dtype=float).reshape(len(pdf), len(aspects))
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), len(aspects)),
                                "aspect": aspects * len(pdf), "score": scores.reshape(-1)})
    return queries.select("query_id", "query").mapInPandas(run, "query_id long, aspect string, score double")


def intent_aspects(scores: DataFrame, aspect_order: list[str],
                   threshold: float = INTENT_THRESHOLD, labels: int = INTENT_LABEL_COUNT) -> DataFrame:
    """query_id, aspect, score for the kept aspects."""
    asked = aspect_order[:labels]
    return scores.where((F.col("score") > threshold) & F.col("aspect").isin(asked))


def aspect_counts(queries: DataFrame, kept: DataFrame) -> DataFrame:
    """query_id, n_aspects (at least 1)."""
    c = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return (queries.select("query_id").join(c, "query_id", "left")
            .select("query_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n_aspects")))
