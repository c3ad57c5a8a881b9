"""Scored pairs and fronts against brute force, in blocks small enough that classes and catalogues are split."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.operators import pairs, scoring, topk
from facetrank.plans import text_queries


def _data(spark, seed=5):
    rng = random.Random(seed)
    halls = [(i, f"h{i}", rng.choice("ab"), float(rng.randrange(5)), rng.choice("xy"), 1) for i in range(40)] + [(40, "n", None, 1.0, "x", 1)]
    hf = [(i, f, k, "text", rng.randrange(1, 6), rng.randrange(14)) for i, *_ in halls for k, f in enumerate(("p", "q", "r")) if rng.random() < 0.7]
    vec = [(v, [rng.uniform(-1, 1) for _ in range(3)]) for v in range(12)] + [(12, None)]
    users = [(u, rng.choice("abz"), rng.choice("xy"), float(rng.randrange(5)), ["t"], "", rng.randrange(14),
              {f: rng.uniform(0, 3) for f in ("p", "q", "r")}) for u in range(15)] + [(15, "a", "x", None, ["t"], "", 0, {})]
    frame = spark.createDataFrame
    hd = scoring.HallData(frame(halls, "id long, name string, location string, price double, hall_type string, size int"),
                          *[frame(hf, "id long, feature string, fidx int, text string, score int, vec_id long")] * 2,
                          frame(vec, "vec_id long, vector array<float>"),
                          frame(users, "user_id long, location string, hall_type string, max_price double, selected_tags array<string>, "
                                "raw_query string, query_vec_id long, priorities map<string,double>"),
                          frame([], "event_id long, ts timestamp, user_id long, hall_id long, action string, stay_time double"), F.lit(14))
    return hd, halls, hf, {v: x for v, x in vec if x}, users


def _cos(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def _want(halls, hf, vec, users, with_type, quality):
    return {(u[0], h[0]): sum(_cos(vec[u[6]], vec[v]) * u[7].get(f, 0.0) * (s / 5 if quality else 1.0) for i, f, _, _, s, v in hf
                              if i == h[0] and v in vec and u[6] in vec)
            for u in users for h in halls
            if u[1] == h[2] and u[3] is not None and h[3] <= u[3] and (not with_type or u[2] == h[4])}


@pytest.mark.parametrize("with_type", [False, True])
def test_pairs_in_blocks(spark, monkeypatch, with_type):
    monkeypatch.setattr(pairs, "USERS", 3)
    monkeypatch.setattr(pairs, "HALLS", 7)
    monkeypatch.setattr(pairs, "CHUNK", 2)
    hd, *rows = _data(spark)
    found = scoring.feature_similarity(scoring.hard_filter(hd.users, hd.halls, with_type), scoring.user_priorities(hd.users, [("p", 0.0)]), hd.hf3, hd)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("FlatMapCoGroupsInArrow") == 1      # pairs are made where they are scored
    got = {(r.user_id, r.id): r.score for r in found.collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in _want(*rows, with_type, True).items()} and len(got) > 20


def test_first_n_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "USERS", 3)
    monkeypatch.setattr(pairs, "TOP_HALLS", 4)
    hd, halls, hf, _, users = _data(spark)
    terms = hd.hf3.select("id", "feature", (F.col("score") / 5.0).alias("t"))
    uw = scoring.user_priorities(hd.users, [("p", 0.0)]).withColumnRenamed("weight", "a")
    got = scoring._score_pairs(scoring.hard_filter(hd.users, hd.halls), uw, terms, 2).collect()
    want = {}
    for u in users:
        s = sorted((-round(sum(x / 5 * u[7].get(f, 0.0) for i, f, _, _, x, _ in hf if i == h[0]), 9), h[0]) for h in halls
                   if u[1] == h[2] and u[2] == h[4] and u[3] is not None and h[3] <= u[3])
        want |= {(u[0], k): i for k, (_, i) in enumerate(s[:2], 1)}
    assert {(r.user_id, r["rank"]): r.id for r in got} == want and want


def test_fronts_are_small_and_hold_every_first_n(spark):
    rng = np.random.default_rng(1)
    x, ids, n = rng.random((20_000, 3)), rng.permutation(20_000), 10
    x[::3] = np.round(x[::3] * 4) / 4
    keep = topk._front(x, ids, n)
    assert len(keep) < 3_000
    for a in rng.random((50, 3)) * (rng.random((50, 3)) < 0.8):
        s = np.round(x @ a, 9)
        assert set(np.lexsort((ids, -s))[:n]) <= set(keep)


def test_no_user_meets_the_whole_catalogue(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 500)
    rng = random.Random(2)
    terms = spark.createDataFrame([(i, f, rng.choice([0.2, 0.4, 0.6, 0.8, 1.0])) for i in range(4000) for f in "abcde" if rng.random() < 0.6],
                                  "id long, feature string, t double")
    sets = spark.createDataFrame([(["a", "b", "c"],), (["d"],), ([],)], "support array<string>")
    size = {tuple(r.support): r["count"] for r in topk.fronts(sets, terms.select("id").distinct(), terms, 5).groupBy("support").count().collect()}
    # the block maxima left a third of the catalogue to each user
    assert size[()] == 5 and 5 <= size[("d",)] < 100 and size[("a", "b", "c")] < 800


@pytest.mark.parametrize("name", ["nested_filter", "hard_filter_2", "hard_filter_3", "hard_filter_in"])
def test_pairs_of_one_location_are_shared_by_tasks(spark, tmp_path, name):
    """One location and type for all: its pairs come from several tasks, and are those of the plain join."""
    halls = [(i, f"h{i}", None if i == 7 else "b", "t", None if i == 8 else 1.0, 1) for i in range(5_000)] + [(9, "h9", "b", "t", 1.0, 1)]
    spark.createDataFrame(halls, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double, p_size int") \
        .write.parquet(str(tmp_path / "part.parquet"))
    ts = datetime.datetime(2024, 1, 1)
    events = [(u, ts, None if u == 3 else u, "purchase", 1.0, '{"k": %d}' % (7 if u == 5 else 0)) for u in range(20)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(0, 0, [1.0])], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in getattr(text_queries, f"q_{name}")(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()]
    assert len({task for *_, task in got}) > 1
    ids = [i for i, _, brand, _, price, _ in halls if brand and (price or name == "nested_filter")]
    users = [e[2] for e in events if e[0] != 5 and not (name == "hard_filter_in" and e[2] is None)]
    assert Counter((u, i) for u, i, _ in got) == Counter((u, i) for u in users for i in ids)


def test_rows_copied_to_parts_do_not_grow_with_the_pairs(spark, monkeypatch):
    """Parts of a fixed size copied each user to every part of its class's halls: users times halls."""
    monkeypatch.setattr(pairs, "MEET_USERS", 2)
    monkeypatch.setattr(pairs, "MEET_HALLS", 5)
    seen, dealt = [], pairs.dealt
    monkeypatch.setattr(pairs, "dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    users = spark.range(400).select(F.col("id").alias("user_id"), F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("location"))
    halls = spark.range(6000).select("id", F.when(F.col("id") % 7 == 0, "b").when(F.col("id") != 1, "a").alias("location"))
    got = pairs.equal_pairs(users, halls, ["location"])
    assert got.count() == got.distinct().count() == 355 * 5141 + 45 * 858
    u, h = (x.count() for x in seen[0])
    assert u + h < 12 * (400 + 6000)
