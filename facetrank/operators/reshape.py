"""Wide <-> long reshaping of venue tables.

* ``unpivot_aspects``: one row per (venue, aspect); a missing text becomes
  '' and texts are stripped; empty texts are kept (they are indexed too).
* ``unpivot_features``: feature text and its quality column (``feat_x`` ->
  ``x_score``) unpivoted together, so the pairing is resolved once; absent
  features (null text) give no row.
* ``nest``/``nested_features``: metadata struct and a features map, and the
  map exploded back to rows.
All are narrow (no shuffle): ``unpivot`` / ``explode`` run inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def score_column(feature: str) -> str:
    return feature.replace("feat_", "", 1) + "_score"


def unpivot_aspects(wide: DataFrame, aspects: list[str], id_cols: list[str],
                    drop_empty: bool = False) -> DataFrame:
    long = wide.unpivot(id_cols, aspects, "aspect", "raw_text")
    out = long.select(*id_cols, "aspect",
                      strip(F.coalesce(F.col("raw_text"), F.lit(""))).alias("text_chunk"))
    return out.where(F.col("text_chunk") != "") if drop_empty else out


def unpivot_features(wide: DataFrame, features: list[str], id_col: str = "id") -> DataFrame:
    """id, feature, fidx, text, score (rows with a null text are dropped)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("fidx"),
                               F.col(f).alias("text"), F.col(score_column(f)).cast("int").alias("score"))
                      for i, f in enumerate(features)])
    return (wide.select(id_col, F.explode(pairs).alias("p"))
            .select(id_col, "p.feature", "p.fidx", "p.text", "p.score")
            .where(F.col("text").isNotNull()))


def nest(wide: DataFrame, features: list[str]) -> DataFrame:
    """id, name, metadata struct<location, price, hall_type>, features map<feature, text>."""
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in features]),
                       lambda e: e["value"].isNotNull())
    return wide.select("id", "name",
                       F.struct("location", "price", "hall_type").alias("metadata"),
                       F.map_from_entries(entries).alias("features"))


def nested_features(nested: DataFrame) -> DataFrame:
    """id, feature, text, all_text (all feature texts joined by a blank, in feature order)."""
    return nested.select("id", F.explode("features").alias("feature", "text"),
                         F.array_join(F.map_values("features"), " ").alias("all_text"))
