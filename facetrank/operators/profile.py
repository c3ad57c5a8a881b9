"""User profiles from action events (batch form; ``streaming.profile`` runs the
same plan on a stream).

* strengths: features of a hall whose quality is at least 4
* points per action: set 1 like 2.0, stay over 10 s 1.0, click 0.2, survey
  3.0; set 2 like 3.0, stay over 15 s 1.0, click 0.2; anything else 0
* profile: every strength of the acted-on hall receives the action's points,
  summed per (user, feature).  Actions on unknown halls are dropped.

Actions are pre-aggregated per (user, hall) before the join to the hall
strengths, so a hot hall (a third of all events) ships one row per user, not
one per event; AQE's skew join splits what remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


ACTION_POINTS_CLICKS = [("click", 1.0, None)]   # click counts as points: one a click


def action_points(action: Column, stay: Column, rules=fixed.ACTION_POINTS_V1) -> Column:
    expr = None
    for name, pts, min_stay in rules:
        cond = action == name
        if min_stay is not None:
            cond = cond & (stay > min_stay)
        expr = F.when(cond, F.lit(pts)) if expr is None else expr.when(cond, F.lit(pts))
    return expr.otherwise(F.lit(0.0))


def strengths(hall_features: DataFrame, min_score: int = fixed.STRENGTH_MIN_SCORE) -> DataFrame:
    """hall_id, feature for features with quality >= min_score."""
    return hall_features.where(F.col("score") >= min_score).select(F.col("id").alias("hall_id"), "feature")


def per_hall_points(actions: DataFrame, rules=fixed.ACTION_POINTS_V1) -> DataFrame:
    """An action row may carry explicit ``points`` (a manual bump of the counters); else the rules apply."""
    rule = action_points(F.col("action"), F.col("stay_time"), rules)
    p = F.coalesce(F.col("points"), rule) if "points" in actions.columns else rule
    pts = actions.select("user_id", "hall_id", p.alias("p"))
    return (pts.where(F.col("p") != 0).groupBy("user_id", "hall_id").agg(F.sum("p").alias("p")))


def profile_points(actions: DataFrame, hall_features: DataFrame, rules=fixed.ACTION_POINTS_V1) -> DataFrame:
    """user_id, feature, points."""
    return (per_hall_points(actions, rules).join(strengths(hall_features), "hall_id")
            .groupBy("user_id", "feature").agg(F.sum("p").alias("points")))


def click_counts(actions: DataFrame, hall_features: DataFrame) -> DataFrame:
    """user_id, feature, v: +1 per click for each strength of the clicked hall."""
    clicks = (actions.where(F.col("action") == "click").groupBy("user_id", "hall_id")
              .agg(F.count(F.lit(1)).alias("c")))
    return (clicks.join(strengths(hall_features), "hall_id")
            .groupBy("user_id", "feature").agg(F.sum("c").cast("double").alias("v")))


def active_interests(points: DataFrame) -> DataFrame:
    return points.where(F.col("points") > 0)
