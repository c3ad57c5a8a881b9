"""Scorer, profile and text-function values worked out by hand (FIXTURES.md section 3)."""

import glob
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from facetrank.functions import fixed
from facetrank.functions import text as tx
from facetrank.operators import profile, scoring
from facetrank.streaming import profile as sprofile

# Sparse 15-hall fixture: id, name, location, price, hall type, (feature, quality) pairs.
HALLS = [
    (1, "강남 오너스홀", "강남구", 3500, "어두운홀", [("parking_space", 5), ("food_quality", 4), ("hall_ceiling", 2)]),
    (2, "청담 가든하우스", "강남구", 4200, "밝은홀", [("food_dessert", 5), ("hall_flower", 5), ("subway_access", 3)]),
    (3, "역삼 아모리스", "강남구", 3800, "어두운홀", [("parking_space", 4), ("food_price_range", 5), ("hall_size", 4)]),
    (4, "압구정 드레스가든", "강남구", 5000, "어두운홀", [("hall_ceiling", 5), ("food_quality", 5), ("waiting_room_size", 5)]),
    (5, "강남 시크릿가든", "강남구", 2900, "야외예식", [("parking_space", 1), ("hall_flower", 4), ("value_for_money", 5)]),
    (6, "선릉 컨벤션", "강남구", 3100, "어두운홀", [("subway_access", 5), ("food_dessert", 2), ("waiting_room_light", 1)]),
    (7, "삼성 베일리하우스", "강남구", 3400, "채플홀", [("waiting_room_light", 5), ("food_serve_type", 3), ("hall_flower", 4)]),
    (8, "서초 아트리움", "서초구", 4500, "어두운홀", [("hall_ceiling", 5), ("parking_space", 5), ("food_quality", 5)]),
    (9, "양재 포레스트", "서초구", 3300, "밝은홀", [("hall_flower", 5), ("waiting_room_size", 2), ("value_for_money", 4)]),
    (10, "서초 로열팰리스", "서초구", 5500, "어두운홀", [("food_quality", 5), ("food_dessert", 5), ("parking_space", 5)]),
    (11, "잠원 더리버", "서초구", 3700, "밝은홀", [("waiting_room_light", 5), ("subway_access", 2), ("hall_size", 2)]),
    (12, "서초 헤리티지", "서초구", 4000, "채플홀", [("food_price_range", 4), ("hall_ceiling", 4), ("food_serve_type", 5)]),
    (13, "반포 엘루체", "서초구", 3200, "밝은홀", [("subway_access", 5), ("parking_space", 2), ("food_quality", 3)]),
    (14, "서초 엘타워", "서초구", 4800, "어두운홀", [("hall_size", 5), ("food_quality", 4), ("waiting_room_flower", 5)]),
    (15, "양재 브라이드벨리", "서초구", 2800, "어두운홀", [("value_for_money", 5), ("food_quality", 4), ("hall_ceiling", 2)]),
]


def _hall_data(spark, tags, actions):
    halls = spark.createDataFrame([(i, n, loc, float(p), t, 0) for i, n, loc, p, t, _ in HALLS],
                                  "id long, name string, location string, price double, hall_type string, size int")
    hf = spark.createDataFrame([(i, "feat_" + f, 0, "text", s, 0) for i, *_, fs in HALLS for f, s in fs],
                               "id long, feature string, fidx int, text string, score int, vec_id long")
    users = spark.createDataFrame([(1, "강남구", "어두운홀", 5000.0, tags, "", 0)],
                                  "user_id long, location string, hall_type string, max_price double, "
                                  "selected_tags array<string>, raw_query string, query_vec_id long")
    acts = spark.createDataFrame([(i, None, 1, h, a, float(s)) for i, (h, a, s) in enumerate(actions)],
                                 "event_id long, ts timestamp, user_id long, hall_id long, action string, stay_time double")
    vec = spark.createDataFrame([], "vec_id long, vector array<float>")
    return scoring.HallData(halls, hf, hf, vec, users, acts, F.lit(1))


SET1 = [(1, "click", 0), (10, "stay", 20), (4, "like", 0)]
SET2 = [(4, "like", 0), (10, "stay", 30)]
TAGS = ["주차 편리", "천고가 높은", "고급스러운 요리가 있는"]


def _points(df):
    return {r["feature"]: round(r["points"], 6) for r in df.collect()}


def test_action_points_set1_and_set2(spark):
    hd = _hall_data(spark, TAGS, SET1)
    p1 = _points(profile.profile_points(hd.actions, hd.hf13))
    assert p1 == {"feat_parking_space": 1.2, "feat_food_quality": 3.2, "feat_food_dessert": 1.0,
                  "feat_hall_ceiling": 2.0, "feat_waiting_room_size": 2.0}
    from facetrank.functions.fixed import ACTION_POINTS_V2
    hd2 = _hall_data(spark, TAGS, SET2)
    p2 = _points(profile.profile_points(hd2.actions, hd2.hf13, ACTION_POINTS_V2))
    assert p2 == {"feat_hall_ceiling": 3.0, "feat_food_quality": 4.0, "feat_waiting_room_size": 3.0,
                  "feat_food_dessert": 1.0, "feat_parking_space": 1.0}
    active = profile.active_interests(profile.profile_points(hd.actions, hd.hf13))
    assert active.count() == 5


def test_unknown_hall_action_is_dropped(spark):
    hd = _hall_data(spark, TAGS, [(999, "like", 0)])
    assert profile.profile_points(hd.actions, hd.hf13).count() == 0


def test_behaviour_ranking(spark):
    hd = _hall_data(spark, TAGS, SET1)
    pts = profile.profile_points(hd.actions, hd.hf13)
    skip = scoring.rec_behaviour(hd, pts, n=4).orderBy("rank").collect()
    assert [r["id"] for r in skip[:3]] == [8, 1, 10]
    assert skip[0]["score"] == pytest.approx(4.912) and skip[1]["score"] == pytest.approx(3.8848)
    prop = scoring.rec_behaviour(hd, pts, n=5, nan_policy="propagate").orderBy("rank").collect()
    assert [(r["id"], r["score"] is None) for r in prop] == [(8, False), (1, False), (2, True), (3, True), (4, True)]
    assert prop[1]["score"] == pytest.approx(3.8848)


def test_dynamic_weights(spark):
    c = spark.createDataFrame([(1, "feat_parking", 5.0), (1, "feat_food", 2.0), (1, "feat_mood", 10.0),
                               (2, "feat_parking", 0.0)], "user_id long, feature string, v double")
    w = {(r["user_id"], r["feature"]): r["weight"] for r in scoring.dynamic_weights(c).collect()}
    assert w[(1, "feat_parking")] == pytest.approx(2.470588, abs=1e-6)
    assert w[(1, "feat_food")] == pytest.approx(1.588235, abs=1e-6)
    assert w[(1, "feat_mood")] == pytest.approx(3.941176, abs=1e-6)
    assert w[(2, "feat_parking")] == 1.0  # zero total


def test_tag_and_click_weights(spark):
    hd = _hall_data(spark, ["주차가 편리한", "뷔페 음식이 맛있는"], [])
    w = {r["feature"]: r["weight"] for r in scoring.tag_keyword_weights(hd.users).collect()}
    assert w == {"feat_parking": 3.0, "feat_food": 3.0, "feat_mood": 1.0}
    clicks = spark.createDataFrame([(1, "feat_mood", 3.0)], "user_id long, feature string, v double")
    w2 = {r["feature"]: r["weight"] for r in scoring.tags_clicks_weights(hd, clicks).collect()}
    assert w2["feat_mood"] == 2.5 and w2["feat_parking"] == 3.0


def test_minmax(spark):
    a = spark.createDataFrame([(1, 40000, 0.0, 0.0), (2, 80000, 0.0, 0.0), (3, 60000, 0.0, 0.0)],
                              "id long, food_price long, food_score double, parking_score double")
    got = {r["id"]: round(r["price_norm"], 6) for r in scoring.minmax_rank(a).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.5}


def test_text_functions(spark):
    df = spark.createDataFrame([("천고가 낮아 아늑한 분위기.", "강남 오너스홀", "밝은 단독 홀, 동선이 깔끔함",
                                 "<name>A</name><catering>맛 있음", "200~250명"),
                                ("국내 최고 수준의 천고와 웅장함.", "인천 부평 그레이스 파티", "", "", "없음"),
                                (None, "남산뜰", None, None, None)],
                               "review string, name string, vibe string, tagged string, num string")
    rows = df.select(tx.negation_factor("review").alias("neg"), tx.region_of("name").alias("region"),
                     *tx.vibe_flags("vibe"), tx.tag_value("tagged", "name").alias("t_name"),
                     tx.tag_value("tagged", "catering").alias("t_cat"), tx.tag_value("tagged", "hall_vibe").alias("t_vibe"),
                     tx.digits_to_int("num").alias("d"), tx.digits_or_null("num").alias("dn")).collect()
    assert [r["neg"] for r in rows[:2]] == [-2.0, 1.0]
    assert [r["region"] for r in rows] == ["강남/서초", "경기/인천", "기타/서울"]
    r0 = rows[0]
    assert (r0["is_bright"], r0["is_private"], r0["is_dark"], r0["is_high_ceiling"], r0["is_outdoor"], r0["is_grand"]) == (1, 1, 0, 0, 0, 0)
    assert (r0["t_name"], r0["t_cat"], r0["t_vibe"]) == ("A", "맛 있음", "None")
    assert rows[2]["t_name"] == "None"  # a missing text reads as 'nan': every tag absent
    assert [r["d"] for r in rows] == [200250, 0, 0]
    assert [r["dn"] for r in rows] == [200250, None, None]


def test_keyword_sentences_matches_regex_semantics(spark):
    import re
    texts = ["주차가 편해요. 그냥 그래요. 식사가 맛있고 뷔페도 좋아요. 마지막 문장 식사", "no dots 식사", "..식사.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"] for r in df.select(tx.keyword_sentences("t", ["식사", "뷔페"]).alias("s")).collect()]
    want = [" ".join(re.findall(r"[^.]*(?:식사|뷔페)[^.]*\.", t)) for t in texts]
    assert got == want


def test_streaming_profile_equals_batch(spark):
    from facetrank.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    src = tempfile.mkdtemp(prefix="facetrank-events-")
    for f in glob.glob(f"{sf}/events.parquet"):
        shutil.copy(f, os.path.join(src, "part-0.parquet"))
    hf = fx.hall_features(spark, sf)
    sink = tempfile.mkdtemp(prefix="facetrank-profile-")
    q = sprofile.start_profile_stream(spark, src, hf, sink, checkpoint=tempfile.mkdtemp(prefix="facetrank-sckpt-"))
    q.awaitTermination(300)
    streamed = {(r["user_id"], r["feature"]): round(r["points"], 6) for r in sprofile.read_profile(spark, sink).collect()}
    batch = {(r["user_id"], r["feature"]): round(r["points"], 6)
             for r in profile.profile_points(fx.actions(spark, sf), hf).collect()}
    assert streamed == batch and len(batch) > 0


def test_manual_bump_points(spark):
    hd = _hall_data(spark, TAGS, [])
    acts = spark.createDataFrame([(1, 8, "bump", 0.0, 3.0)], "user_id long, hall_id long, action string, stay_time double, points double")
    got = _points(profile.profile_points(acts, hd.hf13))
    assert got == {"feat_hall_ceiling": 3.0, "feat_parking_space": 3.0, "feat_food_quality": 3.0}


def test_streaming_click_counts_equal_batch(spark):
    from facetrank.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    src = tempfile.mkdtemp(prefix="facetrank-events-")
    shutil.copy(f"{sf}/events.parquet", os.path.join(src, "part-0.parquet"))
    hf3 = fx.hall_features(spark, sf, fx.HALL_FEATURES_3)
    sink = tempfile.mkdtemp(prefix="facetrank-clicks-")
    q = sprofile.start_click_stream(spark, src, hf3, sink, checkpoint=tempfile.mkdtemp(prefix="facetrank-cckpt-"))
    q.awaitTermination(300)
    streamed = {(r["user_id"], r["feature"]): r["points"] for r in sprofile.read_profile(spark, sink).collect()}
    batch = {(r["user_id"], r["feature"]): r["v"] for r in profile.click_counts(fx.actions(spark, sf), hf3).collect()}
    assert streamed == batch and len(batch) > 0


def test_users_without_a_known_tag_get_the_first_halls(spark):
    hd = _hall_data(spark, ["no such tag"], SET1)
    points = profile.profile_points(hd.actions, hd.hf13)
    rows = sorted(scoring.rec_behaviour(hd, points, n=4).collect(), key=lambda r: r["rank"])
    assert [(r["id"], r["score"]) for r in rows] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    rows = sorted(scoring.rec_behaviour(hd, points, n=4, nan_policy="propagate").collect(), key=lambda r: r["rank"])
    assert [r["id"] for r in rows] == [1, 2, 3, 4]
    # matched halls (place, type, price) first, then the others by id at score 0
    rows = sorted(scoring.rec_ordered_tags(hd, n=8).collect(), key=lambda r: r["rank"])
    matched = [i for i, _, loc, p, t, _ in HALLS if loc == "강남구" and t == "어두운홀" and p <= 5000]
    rest = [i for i, *_ in HALLS if i not in matched]
    assert [r["id"] for r in rows] == (matched + rest)[:8]
    assert [r["matched"] for r in rows] == [True] * min(8, len(matched)) + [False] * (8 - min(8, len(matched)))


def test_hall_totals_sum_all_items(spark):
    from facetrank.functions import fixed
    from facetrank.operators import sentiment
    items = [c for c, _ in fixed.MODEL_RANK_WEIGHTS][:2]
    w = dict(fixed.MODEL_RANK_WEIGHTS)
    df = spark.createDataFrame([("m1", 7, items[0], 2), ("m1", 7, items[1], -1), ("m1", 8, items[1], 2)],
                               "model string, hall_id long, item string, score int")
    got = {(r["model"], r["hall_id"]): r["final_score"] for r in sentiment.hall_totals(df).collect()}
    assert got[("m1", 7)] == pytest.approx(2 * w[items[0]] - w[items[1]])
    assert got[("m1", 8)] == pytest.approx(2 * w[items[1]])


def test_discovery_fill_keeps_its_plan_short(spark):
    """The driver holds the text of a running plan; kept frames nested in each other multiplied it to megabytes."""
    hd = _hall_data(spark, TAGS, SET2)
    df = scoring.rec_integrated(hd, profile.profile_points(hd.actions, hd.hf13, fixed.ACTION_POINTS_V2), 4)
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 100_000
    assert [(r["rank"], r["matched"]) for r in df.orderBy("rank").collect()][0] == (1, True)


def test_halls_are_not_broadcast_by_the_size_of_their_files(spark):
    from facetrank.sources import fixtures as fx
    plan = fx.users(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
