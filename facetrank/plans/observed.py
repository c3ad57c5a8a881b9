"""The two-stage flow with each stage written once, its rows counted by an ``Observation`` and its time taken.

The count is a side effect of the write that the stage needs anyway: no stage is run twice for it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fixed import FINAL_TOP_N, RETRIEVAL_TOP_N
from ..operators import intent, rerank, rollup
from ..session import shared_path
from . import two_stage as ts


@dataclass
class Observed:
    report: DataFrame    # position, stage, n_rows, seconds
    stages: ts.TwoStage


class Stages:
    """Writes stages one after the other and keeps what was observed."""

    def __init__(self, spark):
        self.spark, self.seen = spark, []

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path, seen, began = shared_path(self.spark, f"stage-{name}"), Observation(name), time.time()
        df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(path)
        self.seen.append((len(self.seen) + 1, name, int(seen.get["n_rows"]), round(time.time() - began, 3)))
        return self.spark.read.schema(df.schema).parquet(path)

    def report(self) -> DataFrame:
        return self.spark.createDataFrame(self.seen, "position long, stage string, n_rows long, seconds double")


def run(inp: ts.Inputs, scorer=None, n: int = RETRIEVAL_TOP_N, top_n: int = FINAL_TOP_N) -> Observed:
    stage = Stages(inp.chunks.sparkSession)
    scores = intent.vocabulary_scores(inp.chunks, inp.queries, inp.index.terms)
    kept = stage("intent", intent.intent_aspects(scores, inp.aspect_order))
    counts = intent.aspect_counts(inp.queries, kept)
    cands = stage("candidates", ts.hybrid_candidates(inp, kept, n))
    reranked = stage("reranked", rerank.rerank(cands, inp.queries, scorer))
    venues = stage("venues", rollup.soft_weight_rollup(reranked, counts))
    top = stage("top", rollup.top_venues(venues, top_n))
    return Observed(stage.report(), ts.TwoStage(kept, counts, cands, reranked, venues, top))
