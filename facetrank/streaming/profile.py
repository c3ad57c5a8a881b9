"""User profiles maintained by Structured Streaming.

events (file or Kafka source) -> actions -> points per event
  -> stream-static join with the hall strengths (features with quality >= 4)
  -> groupBy(user_id, feature).sum(points)   [update mode, state in the JVM, never expires]
  -> foreachBatch: the totals that a micro-batch changed are merged into the profile table, keyed by (user, feature),
     with the batch's number as version.

The profile table (``operators.upsert.KeyedTable``) holds one row a key, so it grows with the profiles and not with the
batches, and a batch rewrites only the buckets of the users it saw.  Merging a replayed batch again changes nothing: its
rows have the same version and the same totals.  The reference keeps the profile for ever and has no late
data rule, so there is no watermark here either (a dedup of repeated
event_ids within a watermark would be an extension, not reproduced).

Executors can be lost at any time: state and offsets live in the checkpoint
location, which must be on the shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import fixed
from ..operators.profile import ACTION_POINTS_CLICKS, action_points, strengths
from ..operators.upsert import KeyedTable
from ..session import shared_path

EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
PROFILE_SCHEMA = StructType([StructField("user_id", LongType()), StructField("feature", StringType()),
                             StructField("points", DoubleType()), StructField("batch", LongType())])


def profile_table(spark: SparkSession, sink: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, sink, PROFILE_SCHEMA, ["user_id", "feature"], "batch", buckets)


def actions_of(events: DataFrame) -> DataFrame:
    action = (F.when(F.col("event_type") == "click", "click")
              .when(F.col("event_type") == "view", "stay")
              .when(F.col("event_type") == "purchase", "like")
              .when(F.col("event_type") == "signup", "survey")
              .otherwise("none"))
    return events.select("event_id", "ts", "user_id",
                         F.get_json_object("props", "$.k").cast("long").alias("hall_id"),
                         action.alias("action"), F.col("value").alias("stay_time"))


def profile_updates(events: DataFrame, hall_features: DataFrame, rules=fixed.ACTION_POINTS_V1) -> DataFrame:
    a = actions_of(events)
    pts = (a.select("user_id", "hall_id", action_points(F.col("action"), F.col("stay_time"), rules).alias("p"))
           .where(F.col("p") != 0))
    return (pts.join(strengths(hall_features), "hall_id")
            .groupBy("user_id", "feature").agg(F.sum("p").alias("points")))


def start_profile_stream(spark: SparkSession, events_path: str, hall_features: DataFrame, sink: str,
                         rules=fixed.ACTION_POINTS_V1, checkpoint: str | None = None,
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    events = reader.parquet(events_path)
    updates = profile_updates(events, hall_features, rules)

    checkpoint = checkpoint or shared_path(spark, "profile-stream-checkpoint")
    if not stored(spark, checkpoint):                        # a new stream starts from an empty table
        profile_table(spark, sink).create()

    def write_batch(df: DataFrame, batch_id: int) -> None:
        profile_table(df.sparkSession, sink).merge(df.withColumn("batch", F.lit(batch_id).cast("long")))

    w = (updates.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_click_stream(spark: SparkSession, events_path: str, hall_features_3: DataFrame, sink: str,
                       checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Click counts (+1 per click for each strength of the clicked hall): the same plan with one rule."""
    return start_profile_stream(spark, events_path, hall_features_3, sink, ACTION_POINTS_CLICKS,
                                checkpoint, available_now)


def stored(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream has begun at this checkpoint."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_profile(spark: SparkSession, sink: str) -> DataFrame:
    """user_id, feature, points."""
    return profile_table(spark, sink).read().select("user_id", "feature", "points")


def streamed_profile(events: DataFrame, hall_features: DataFrame, rules=fixed.ACTION_POINTS_V1, loads: int = 2) -> DataFrame:
    """The profile of all events, by a stream that is stopped after each load of files and started again at its checkpoint."""
    spark = events.sparkSession
    source, sink, checkpoint = (shared_path(spark, f"profile-{x}") for x in ("events", "table", "checkpoint"))
    columns = [c.split()[0] for c in EVENTS_SCHEMA.split(", ")]
    load = F.pmod(F.xxhash64("event_id"), F.lit(loads)).cast("int")
    staged = shared_path(spark, "profile-loads")
    events.select(*columns).withColumn("load", load).write.partitionBy("load").parquet(staged)
    for k in range(loads):                                   # files that arrive while the stream is down
        spark.read.schema(EVENTS_SCHEMA).parquet(f"{staged}/load={k}").write.mode("append").parquet(source)
        query = start_profile_stream(spark, source, hall_features, sink, rules, checkpoint)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    return read_profile(spark, sink)
