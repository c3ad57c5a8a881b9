"""Sentiment labels, similarity buckets and the score tables built on them.

The reviewed notebook labels each personal text with three classifiers and two
sentence-similarity models.  Here a labeller is any DataFrame
(doc_id, model, label[, prob]) - a real model runs upstream as a pandas UDF
(see ``operators.encode``) - and the shipped stand-in derives the labels from
the ``labels`` table so that a SQL oracle can follow:

  m1  positive if quality = 1, negative if quality = 0
  m2  negative if toxic = 1, positive if toxic = 0
  m3  positive if quality = 1 and toxic = 0, negative if toxic = 1, else neutral
Unlabelled documents have no label (score 0).

Label -> score: positive 2, negative -1, anything else 0; text shorter than 2
or equal to 'none' scores 0.  Similarity buckets: cos > 0.6 -> 2, cos < 0.3 ->
-1, else 0; text shorter than 5 or 'none' scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import cosine

MODELS = ["m1", "m2", "m3"]
SIM_MODELS = ["s1", "s2"]


def personal_column(aspect_col: str, aspects: list[str]) -> F.Column:
    """Map the fixture aspects onto the four personal columns, in order."""
    expr = None
    for a, c in zip(aspects, fixed.PERSONAL_COLUMNS):
        expr = F.when(F.col(aspect_col) == a, F.lit(c)) if expr is None else expr.when(F.col(aspect_col) == a, F.lit(c))
    return expr


def stand_in_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, model, label."""
    j = docs.select("doc_id").join(labels, "doc_id", "left")
    m1 = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
    m2 = F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive")
    m3 = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "positive")
          .when(F.col("toxic") == 1, "negative").when(F.col("quality").isNotNull(), "neutral"))
    arr = F.array(*[F.struct(F.lit(m).alias("model"), e.alias("label")) for m, e in zip(MODELS, [m1, m2, m3])])
    return j.select("doc_id", F.explode(arr).alias("x")).select("doc_id", "x.model", "x.label")


def label_score(text: F.Column, label: F.Column) -> F.Column:
    t = F.coalesce(text, F.lit(""))
    lab = F.upper(F.coalesce(label, F.lit("")))
    skip = (F.length(t) < 2) | (F.lower(t) == "none")
    return (F.when(skip, F.lit(0))
            .when(F.contains(lab, F.lit("POSITIVE")), F.lit(fixed.SENTIMENT_POSITIVE))
            .when(F.contains(lab, F.lit("NEGATIVE")), F.lit(fixed.SENTIMENT_NEGATIVE))
            .otherwise(F.lit(0)))


def sentiment_scores(docs: DataFrame, labelled: DataFrame, aspects: list[str]) -> DataFrame:
    """doc_id, item (personal column), model, score."""
    return (docs.select("doc_id", "text", personal_column("aspect", aspects).alias("item"))
            .join(labelled, "doc_id")
            .select("doc_id", "item", "model", label_score(F.col("text"), F.col("label")).alias("score")))


def similarity_buckets(docs: DataFrame, doc_vectors: DataFrame, ref_vectors: DataFrame,
                       aspects: list[str]) -> DataFrame:
    """doc_id, item, model, score.  ref_vectors: (model, item, rvec).  A document without a vector scores 0."""
    d = (docs.select("doc_id", "text", personal_column("aspect", aspects).alias("item"))
         .join(doc_vectors, "doc_id", "left"))
    x = d.join(ref_vectors, "item")
    c = cosine("vector", "rvec")
    t = F.coalesce(F.col("text"), F.lit(""))
    skip = (F.length(t) < 5) | (F.lower(t) == "none")
    score = (F.when(skip, F.lit(0)).when(c > fixed.SIMILARITY_HIGH, F.lit(fixed.SENTIMENT_POSITIVE))
             .when(c < fixed.SIMILARITY_LOW, F.lit(fixed.SENTIMENT_NEGATIVE)).otherwise(F.lit(0)))
    return x.select("doc_id", "item", "model", score.alias("score"))


def positive_probability(text: F.Column, label: F.Column, prob: F.Column) -> F.Column:
    """0.5 for text shorter than 5; prob if the label is LABEL_1 else 1 - prob; 0.5 without a label."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(F.length(t) < 5, F.lit(0.5)).when(label.isNull(), F.lit(0.5))
            .when(label == "LABEL_1", prob).otherwise(F.lit(1.0) - prob))


def reason_label(score: F.Column) -> F.Column:
    return (F.when(score > 1, F.lit(fixed.REASON_GOOD)).when(score >= 0, F.lit(fixed.REASON_FAIR))
            .otherwise(F.lit(fixed.REASON_POOR)))


def item_weight(item: F.Column) -> F.Column:
    expr = None
    for c, w in fixed.MODEL_RANK_WEIGHTS:
        expr = F.when(item == c, F.lit(w)) if expr is None else expr.when(item == c, F.lit(w))
    return expr.otherwise(F.lit(fixed.MODEL_RANK_OTHER_WEIGHT))


def hall_totals(scores: DataFrame) -> DataFrame:
    """model, hall_id, final_score: the weighted buckets of all of a hall's items, summed."""
    return (scores.groupBy("model", "hall_id")
            .agg(F.sum(F.col("score") * item_weight(F.col("item"))).alias("final_score")))
