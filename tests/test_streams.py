"""The stored keyed table, and the streams that keep user profiles in one."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from facetrank.functions import fixed
from facetrank.operators import profile
from facetrank.operators.upsert import KeyedTable, upsert
from facetrank.session import shared_path
from facetrank.sources import fixtures as fx
from facetrank.streaming import profile as streaming

SF = "/root/testdata/sf0.001"


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def _table(spark, buckets=8):
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit(0).alias("version"), F.lit("old").alias("v"))
    return KeyedTable(spark, shared_path(spark, "keyed-test"), rows.schema, ["k"], "version", buckets).create(rows)


def test_merge_rewrites_only_the_touched_buckets(spark):
    t = _table(spark)
    before = _files(t.path)
    assert len(before) == 8 and t.read().count() == 400
    new = spark.createDataFrame([(3, 1, "new"), (1003, 1, "added")], t.schema)
    touched = t.merge(new)
    after = _files(t.path)
    bucket = lambda f: int(f.split("bucket=")[1].split("/")[0])
    changed = {bucket(f) for f in set(before) ^ set(after)}
    assert 1 <= len(touched) <= 2 and changed == set(touched)
    assert all(after[f] == before[f] for f in before if bucket(f) not in touched)
    rows = {r.k: (r.version, r.v) for r in t.read().collect()}
    assert len(rows) == 401 and rows[3] == (1, "new") and rows[1003] == (1, "added") and rows[4] == (0, "old")


def test_winner_of_equal_versions_and_replays(spark):
    t = _table(spark)
    t.merge(spark.createDataFrame([(1, 0, "later load"), (2, -1, "too old"), (None, 5, "null key")], t.schema))
    load = spark.createDataFrame([(5, 2, "a"), (5, 2, "b"), (5, 1, "c")], t.schema)
    t.merge(load)
    first = sorted((r.k is None, r.k or 0, r.version, r.v) for r in t.read().collect())
    assert (False, 1, 0, "later load") in first and (False, 2, 0, "old") in first and (True, 0, 5, "null key") in first
    assert len([r for r in first if r[1] == 5]) == 1
    t.merge(load)                                            # the same load again
    assert sorted((r.k is None, r.k or 0, r.version, r.v) for r in t.read().collect()) == first
    assert t.merge(load.filter("false")) == []
    old = spark.createDataFrame([(1, 0, "x"), (2, 3, "y")], "k long, version int, v string")
    new = spark.createDataFrame([(1, 0, "z"), (2, 2, "w"), (3, 0, "q")], "k long, version int, v string")
    assert {(r.k, r.v) for r in upsert(old, new, "k").collect()} == {(1, "z"), (2, "y"), (3, "q")}


@pytest.mark.parametrize("rules", ["ACTION_POINTS_V1", "ACTION_POINTS_V2", "ACTION_POINTS_CLICKS"])
def test_stream_after_a_restart_equals_batch(spark, rules):
    rules = getattr(fixed, rules, None) or getattr(profile, rules)
    hf = fx.hall_features(spark, SF)
    got = {(r.user_id, r.feature): round(r.points, 6) for r in streaming.streamed_profile(
        fx.table(spark, SF, "events"), hf, rules, loads=3).collect()}
    want = {(r.user_id, r.feature): round(r.points, 6) for r in profile.profile_points(fx.actions(spark, SF), hf, rules).collect()}
    assert got == want and len(want) > 0


def test_the_table_does_not_grow_with_the_batches(spark):
    hf = fx.hall_features(spark, SF)
    source, sink, checkpoint = (shared_path(spark, f"bounded-{x}") for x in ("events", "table", "checkpoint"))
    events = fx.table(spark, SF, "events").select(*[c.split()[0] for c in streaming.EVENTS_SCHEMA.split(", ")])
    sizes = []
    for _ in range(3):                                       # the same users again and again
        events.write.mode("append").parquet(source)
        q = streaming.start_profile_stream(spark, source, hf, sink, checkpoint=checkpoint)
        q.awaitTermination()
        assert q.exception() is None
        sizes.append((streaming.read_profile(spark, sink).count(), len(_files(sink))))
    assert len(set(sizes)) == 1
    got = {(r.user_id, r.feature): round(r.points, 6) for r in streaming.read_profile(spark, sink).collect()}
    want = {(r.user_id, r.feature): round(3 * r.points, 6) for r in profile.profile_points(fx.actions(spark, SF), hf).collect()}
    assert got == want
