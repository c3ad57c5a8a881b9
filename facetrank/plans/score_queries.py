"""Registered queries for the preference scorers, profiles and sentiment tables.

Each entry is ``key -> (spark_callable, duckdb_sql)``.  The SQL is brute force
(every user against every hall where the reviewed code does that) so that it
checks the block-maxima top-n and the pre-aggregated profile joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import negation_factor as neg_expr
from ..operators import profile, reshape, scoring, sentiment
from ..operators.lexical import rank_within
from ..sources import fixtures as fx
from ..streaming import profile as streaming
from . import sqlx
from .oracle import cosine as sql_cos
from .sqlx import NVEC, lit
from .text_queries import SQL_PREF_TYPES, preferred_types

F3, F13 = fx.HALL_FEATURES_3, fx.HALL_FEATURES_13
D5 = "5.0::DOUBLE"


def _r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def _hd(spark, sf) -> scoring.HallData:
    return scoring.HallData.from_sf(spark, sf)


def full_click_counts(hd: scoring.HallData) -> DataFrame:
    """user_id, feature, v over the three features, zero where the user never clicked."""
    cc = profile.click_counts(hd.actions, hd.hf3)
    base = hd.users.select("user_id", F.explode(F.array(*[F.lit(f) for f in F3])).alias("feature"))
    return base.join(cc, ["user_id", "feature"], "left").select("user_id", "feature", F.coalesce("v", F.lit(0.0)).alias("v"))


def points_v1(hd):
    return profile.profile_points(hd.actions, hd.hf13, fixed.ACTION_POINTS_V1)


def points_v2(hd):
    return profile.profile_points(hd.actions, hd.hf13, fixed.ACTION_POINTS_V2)


# --------------------------------------------------------------------- SQL pieces
def _emb() -> str:
    return "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


BASE = (f"WITH {sqlx.USERS}, {sqlx.HALLS}, {_emb()}, {sqlx.halls_wide(F3, 'hw3')}, {sqlx.hall_long(F3, 'hw3', 'hf3')}, "
        f"{sqlx.halls_wide(F13, 'hw13')}, {sqlx.hall_long(F13, 'hw13', 'hf13')}")

TM = "tm(tag, feature, tag_index) AS (VALUES " + ", ".join(
    f"({lit(t)}, {lit(f)}, {i})" for i, (t, f) in enumerate(fixed.TAG_MAP)) + ")"

P5 = "pairs AS (SELECT u.user_id, h.id FROM halls h JOIN users u ON h.location = u.location AND h.price <= u.max_price)"
P6 = ("pairs AS (SELECT u.user_id, h.id FROM halls h JOIN users u ON h.location = u.location "
      "AND h.price <= u.max_price AND h.hall_type = u.hall_type)")


_R1 = "[" + ", ".join(f"{w}::DOUBLE" for _, w in fixed.R1_WEIGHTS) + "]"
PRIO = "prio AS (" + " UNION ALL ".join(
    f"SELECT user_id, {lit(f)} AS feature, ({_R1})[((user_id + {i}) % 3) + 1] * (1.0::DOUBLE + (user_id % 4) * 0.25::DOUBLE) AS weight FROM users"
    for i, f in enumerate(F3)) + ")"


def _weights_text(cte: str) -> str:
    return f"""wt AS (SELECT user_id, string_agg(feature || '=' || printf('%.4f', weight), ',' ORDER BY feature) AS weights
      FROM {cte} GROUP BY user_id)"""


def _fs(weights_cte: str, per_user: bool, quality: bool, hf: str = "hf3", name: str = "fs") -> str:
    wjoin = f"JOIN {weights_cte} w ON w.user_id = p.user_id" if per_user else f"JOIN {weights_cte} w ON true"
    term = f"{sql_cos('uv.v', 'fv.v')} * w.weight"
    if quality:
        term = f"{term} * f.score / {D5}"
    return f"""fsx AS (SELECT p.user_id, p.id, sum({term}) AS score
      FROM pairs p JOIN users u ON u.user_id = p.user_id JOIN emb uv ON uv.vec_id = u.query_vec_id
      {wjoin} JOIN {hf} f ON f.id = p.id AND f.feature = w.feature JOIN emb fv ON fv.vec_id = f.vec_id
      GROUP BY p.user_id, p.id),
{name} AS (SELECT p.user_id, p.id, coalesce(x.score, 0.0) AS score FROM pairs p LEFT JOIN fsx x USING (user_id, id))"""


def _rank(src: str, score: str = "score", extra: str = "") -> str:
    """The whole filtered list, best first per user (order is not part of the comparison)."""
    return (f"SELECT user_id, id{extra}, round({score}, 6) AS {score} FROM {src} "
            f"ORDER BY user_id, round({score}, 9) DESC, id")


CLICKS = f"""strength3 AS (SELECT id AS hall_id, feature FROM hf3 WHERE score >= {fixed.STRENGTH_MIN_SCORE}),
clicks AS (SELECT user_id, hall_id, count(*) AS c FROM acts WHERE action = 'click' GROUP BY user_id, hall_id),
cc0 AS (SELECT c.user_id, s.feature, CAST(sum(c.c) AS DOUBLE) AS v FROM clicks c JOIN strength3 s USING (hall_id) GROUP BY ALL),
cc AS (SELECT u.user_id, f.feature, coalesce(cc0.v, 0.0) AS v FROM users u
       JOIN (VALUES {', '.join(f'({lit(f)})' for f in F3)}) f(feature) ON true
       LEFT JOIN cc0 ON cc0.user_id = u.user_id AND cc0.feature = f.feature),
dw AS (SELECT user_id, feature, CASE WHEN sum(v) OVER (PARTITION BY user_id) = 0 THEN 1.0
             ELSE 1.0 + v / sum(v) OVER (PARTITION BY user_id) * {fixed.DYNAMIC_SCALE}::DOUBLE END AS weight FROM cc)"""


def _kw_weights() -> str:
    parts = []
    for feature, words in fixed.TAG_KEYWORDS:
        cond = " OR ".join(f"contains(t, {lit(w)})" for w in words)
        parts.append(f"SELECT user_id, {lit(feature)} AS feature, {fixed.TAG_KEYWORD_BASE}::DOUBLE + "
                     f"{fixed.TAG_KEYWORD_BONUS}::DOUBLE * len(list_filter(coalesce(selected_tags, []), lambda t: {cond})) AS weight FROM users")
    return "kw AS (" + " UNION ALL ".join(parts) + ")"


def _points(rules, name: str) -> str:
    whens = []
    for act, pts, min_stay in rules:
        cond = f"action = {lit(act)}" + (f" AND stay_time > {min_stay}" if min_stay is not None else "")
        whens.append(f"WHEN {cond} THEN {pts}::DOUBLE")
    return f"""{name}_ap AS (SELECT user_id, hall_id, sum(p) AS p FROM (SELECT user_id, hall_id, CASE {' '.join(whens)} ELSE 0.0 END AS p FROM acts)
             WHERE p <> 0 GROUP BY user_id, hall_id),
{name} AS (SELECT a.user_id, s.feature, sum(a.p) AS points FROM {name}_ap a
           JOIN (SELECT id AS hall_id, feature FROM hf13 WHERE score >= {fixed.STRENGTH_MIN_SCORE}) s USING (hall_id)
           GROUP BY a.user_id, s.feature)"""


TPOS = f"""tpos AS (SELECT user_id, unnest(range(len(selected_tags))) AS pos, unnest(selected_tags) AS tag FROM users),
tsc AS (SELECT t.user_id, t.pos, t.tag, tm.feature, tm.tag_index,
               CASE t.pos WHEN 0 THEN {fixed.TAG_POSITION_WEIGHTS[0]}::DOUBLE WHEN 1 THEN {fixed.TAG_POSITION_WEIGHTS[1]}::DOUBLE
                          WHEN 2 THEN {fixed.TAG_POSITION_WEIGHTS[2]}::DOUBLE ELSE {fixed.TAG_POSITION_DEFAULT}::DOUBLE END AS weight,
               1.0::DOUBLE / (t.pos + 1) AS inv_weight
        FROM tpos t JOIN tm USING (tag))"""


def _neg(x: str) -> str:
    return f"CASE WHEN {sqlx.any_kw(x, fixed.NEGATIVE_SIGNALS)} THEN {fixed.NEGATION_FACTOR}::DOUBLE ELSE 1.0 END"


def _terms(kind: str) -> str:
    nonempty = f"f.text IS NOT NULL AND {sqlx.strip('f.text')} <> ''"
    q = f"(f.score / {D5})"
    if kind == "behaviour":
        return f"terms AS (SELECT f.id, f.feature, {fixed.FIXED_SIM_R8}::DOUBLE * {q} AS t FROM hf13 f WHERE {nonempty})"
    t = f"{sql_cos('tv.v', 'fv.v')} * {q}"
    if kind == "integrated":
        t = f"{t} * {_neg('f.text')}"
    return f"""terms AS (SELECT f.id, f.feature, {t} AS t FROM hf13 f JOIN tm USING (feature)
      JOIN emb fv ON fv.vec_id = f.vec_id JOIN emb tv ON tv.vec_id = tm.tag_index WHERE {nonempty})"""


def _uw(points: str | None, bonus: float) -> str:
    if points is None:
        return "uw AS (SELECT user_id, feature, sum(weight) AS a FROM tsc GROUP BY user_id, feature)"
    return (f"uw AS (SELECT t.user_id, t.feature, sum(t.weight + {bonus}::DOUBLE * coalesce(p.points, 0.0)) AS a "
            f"FROM tsc t LEFT JOIN {points} p ON p.user_id = t.user_id AND p.feature = t.feature GROUP BY t.user_id, t.feature)")


def _all_scores(matched: bool) -> str:
    m = ("(h.location = u.location AND h.price <= u.max_price AND h.hall_type = u.hall_type)" if matched else "false")
    return f"""allp AS (SELECT u.user_id, h.id, {m} AS matched FROM users u JOIN halls h ON true),
sc AS (SELECT p.user_id, p.id, p.matched, coalesce(sum(uw.a * coalesce(t.t, 0.0)), 0.0) AS score
       FROM allp p LEFT JOIN uw ON uw.user_id = p.user_id LEFT JOIN terms t ON t.id = p.id AND t.feature = uw.feature
       GROUP BY p.user_id, p.id, p.matched)"""


def _md_sql(n: int, kind: str, points: str | None, bonus: float, cols: str) -> str:
    pts = f", {_points(fixed.ACTION_POINTS_V2 if points == 'pts2' else fixed.ACTION_POINTS_V1, points)}" if points else ""
    return f"""{BASE}, {TM}{pts}, {TPOS}, {_terms(kind)}, {_uw(points, bonus)}, {_all_scores(True)}
SELECT {cols} FROM (SELECT user_id, id, matched, score, row_number() OVER (PARTITION BY user_id
        ORDER BY matched DESC, round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= {n}"""


# ------------------------------------------------------------------ Spark callables
def q_rec_weighted_sim(spark, sf):
    return scoring.rec_weighted_sim(_hd(spark, sf)).select("user_id", "id", _r6("score"))


SQL_R1 = f"""{BASE}, {P5}, {PRIO}, {_fs('prio', True, False)}
{_rank('fs')}"""


def q_rec_quality(spark, sf):
    return scoring.rec_quality(_hd(spark, sf)).select("user_id", "id", "name", _r6("score"))


SQL_R2 = f"""{BASE}, {P5}, {PRIO}, {_fs('prio', True, True)},
fs2 AS (SELECT fs.*, h.name FROM fs JOIN halls h USING (id))
{_rank('fs2', extra=', name')}"""


def q_rec_base_plus(spark, sf):
    hd = _hd(spark, sf)
    nested = reshape.nest(fx.halls_wide(spark, sf, F3), F3)
    return scoring.rec_base_plus(hd, nested).select("user_id", "id", _r6("score"))


SQL_R3 = f"""{BASE}, pairs AS (SELECT u.user_id, h.id FROM halls h JOIN users u ON h.location = u.location),
{PRIO}, {_fs('prio', True, False)},
b AS (SELECT p.user_id, p.id, {sql_cos('uv.v', 'hv.v')} AS base FROM pairs p JOIN users u USING (user_id)
      JOIN emb uv ON uv.vec_id = u.query_vec_id JOIN emb hv ON hv.vec_id = p.id % {NVEC}),
s AS (SELECT fs.user_id, fs.id, b.base + fs.score AS score FROM fs JOIN b USING (user_id, id))
{_rank('s')}"""


def q_rec_match_rate(spark, sf):
    return scoring.rec_match_rate(_hd(spark, sf)).select("user_id", "id", _r6("match_rate"))


SQL_R4 = f"""{BASE}, {P6}, {PRIO}, {_fs('prio', True, True)},
tw AS (SELECT user_id, sum(weight) AS total FROM prio GROUP BY user_id),
s AS (SELECT user_id, id, score / total * 100.0::DOUBLE AS match_rate FROM fs JOIN tw USING (user_id))
{_rank('s', 'match_rate')}"""


def q_rec_profile(spark, sf):
    hd = _hd(spark, sf)
    return scoring.rec_profile(hd, full_click_counts(hd)).select("user_id", "id", _r6("score"), "weights")


SQL_R5 = f"""{BASE}, {P6}, {CLICKS}, {_fs('dw', True, True)}, {_weights_text('dw')},
fw AS (SELECT fs.*, wt.weights FROM fs LEFT JOIN wt USING (user_id))
{_rank('fw', extra=', weights')}"""


def q_rec_tags_clicks(spark, sf):
    hd = _hd(spark, sf)
    return scoring.rec_tags_clicks(hd, full_click_counts(hd)).select("user_id", "id", _r6("score"), "weights")


SQL_R6 = f"""{BASE}, {P6}, {CLICKS}, {_kw_weights()},
tw AS (SELECT k.user_id, k.feature, k.weight + {fixed.CLICK_BONUS}::DOUBLE * coalesce(c.v, 0.0) AS weight
       FROM kw k LEFT JOIN cc c ON c.user_id = k.user_id AND c.feature = k.feature),
{_fs('tw', True, True)}, {_weights_text('tw')},
fw AS (SELECT fs.*, wt.weights FROM fs LEFT JOIN wt USING (user_id))
{_rank('fw', extra=', weights')}"""


def q_rec_ordered_tags(spark, sf):
    return scoring.rec_ordered_tags(_hd(spark, sf)).select("user_id", "id", "matched", _r6("score"), "rank")


SQL_R7 = _md_sql(10, "ordered", None, 0.0, "user_id, id, matched, round(score, 6) AS score, rank")


def q_matched_discovery(spark, sf):
    hd = _hd(spark, sf)
    out = scoring.matched_then_discovery(hd, scoring.tag_user_weights(hd), scoring.tag_terms(hd, "ordered"), 20)
    return out.select("user_id", "id", "matched", "rank")


SQL_MD = _md_sql(20, "ordered", None, 0.0, "user_id, id, matched, rank")


def q_rec_behaviour(spark, sf):
    hd = _hd(spark, sf)
    return scoring.rec_behaviour(hd, points_v1(hd)).select("user_id", "id", _r6("score"), "rank")


SQL_R8 = f"""{BASE}, {TM}, {_points(fixed.ACTION_POINTS_V1, 'pts1')}, {TPOS}, {_terms('behaviour')},
{_uw('pts1', fixed.BEHAVIOUR_BONUS_R8)}, {_all_scores(False)}
SELECT * FROM (SELECT user_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id
        ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 10"""


def q_rec_integrated(spark, sf):
    hd = _hd(spark, sf)
    return scoring.rec_integrated(hd, points_v2(hd)).select("user_id", "id", "matched", _r6("score"), "rank")


SQL_R10 = _md_sql(10, "integrated", "pts2", fixed.BEHAVIOUR_BONUS_R9,
                  "user_id, id, matched, round(score, 6) AS score, rank")


def q_rec_half_half(spark, sf):
    return scoring.rec_half_half(_hd(spark, sf)).select("user_id", "id", _r6("final_score"))


_HALF = {t: (f, dict(fixed.HALF_HALF_WEIGHTS)[n]) for t, n, f in scoring.HALF_HALF_TAGS}
HALF_TAGS = [(t, *_HALF.get(t, (f, fixed.HALF_HALF_UNKNOWN))) for t, f in fixed.TAG_MAP]
SQL_R11 = f"""{BASE}, {P6},
ht(tag, feature, weight) AS (VALUES {', '.join(f"({lit(t)}, {lit(f)}, {w}::DOUBLE)" for t, f, w in HALF_TAGS)}),
ut AS (SELECT u.user_id, ht.feature, ht.weight FROM (SELECT user_id, unnest(selected_tags) AS tag FROM users) u JOIN ht USING (tag)),
tp AS (SELECT p.user_id, p.id, sum(f.score / {D5} * ut.weight) AS tag_score FROM pairs p JOIN ut USING (user_id)
       JOIN hf13 f ON f.id = p.id AND f.feature = ut.feature GROUP BY p.user_id, p.id),
sim AS (SELECT p.user_id, p.id, list_dot_product(uv.v, hv.v) AS similarity FROM pairs p JOIN users u USING (user_id)
        JOIN emb uv ON uv.vec_id = u.query_vec_id JOIN emb hv ON hv.vec_id = p.id % {NVEC}),
s AS (SELECT s.user_id, s.id, {fixed.HALF_SHARE}::DOUBLE * s.similarity + {fixed.HALF_SHARE}::DOUBLE * coalesce(tp.tag_score, 0.0) AS final_score
      FROM sim s LEFT JOIN tp USING (user_id, id))
{_rank('s', 'final_score')}"""


def q_tag_vector_rank(spark, sf):
    hd = _hd(spark, sf)
    return scoring.rec_tag_vector(hd, preferred_types(spark, sf)).select("user_id", "id", "score", "match_reason")


SQL_R12 = f"""{BASE}, {TM}, {TPOS}, {SQL_PREF_TYPES},
pairs AS (SELECT u.user_id, h.id FROM halls h JOIN users u ON h.location = u.location AND h.price <= u.max_price
          JOIN ptypes p ON p.user_id = u.user_id AND list_contains(p.types, h.hall_type)),
tp AS (SELECT p.user_id, p.id, sum(f.score / {D5} * t.inv_weight) AS tag_score FROM pairs p JOIN tsc t USING (user_id)
       JOIN hf13 f ON f.id = p.id AND f.feature = t.feature GROUP BY p.user_id, p.id),
sim AS (SELECT p.user_id, p.id, {sql_cos('uv.v', 'hv.v')} AS similarity FROM pairs p JOIN users u USING (user_id)
        JOIN emb uv ON uv.vec_id = u.query_vec_id JOIN emb hv ON hv.vec_id = p.id % {NVEC}),
s AS (SELECT s.user_id, s.id,
             round({fixed.VECTOR_SHARE_R12}::DOUBLE * s.similarity + {fixed.TAG_SHARE_R12}::DOUBLE * coalesce(tp.tag_score, 0.0), 4) AS score,
             CASE WHEN len(u.selected_tags) > 0 THEN u.selected_tags[1] || {lit(fixed.MATCH_REASON_SUFFIX)} ELSE '' END AS match_reason
      FROM sim s LEFT JOIN tp USING (user_id, id) JOIN users u ON u.user_id = s.user_id)
{_rank('s', extra=', match_reason')}"""


def q_pref_score(spark, sf):
    hd = _hd(spark, sf)
    pairs = scoring.hard_filter(hd.users, hd.halls)
    w = scoring.user_priorities(hd.users)
    return scoring.feature_similarity(pairs, w, hd.hf3, hd).select("user_id", "id", _r6("score"))


SQL_PREF = f"""{BASE}, {P6}, {PRIO}, {_fs('prio', True, True)}
SELECT user_id, id, round(score, 6) AS score FROM fs"""


def q_tag_scores(spark, sf):
    return scoring.tag_scores(fx.users(spark, sf), spark).select(
        "user_id", "pos", "tag", "feature", "weight", _r6("inv_weight"))


SQL_TAG_SCORES = f"""WITH {sqlx.USERS}, {TM}, {TPOS}
SELECT user_id, pos, tag, feature, weight, round(inv_weight, 6) AS inv_weight FROM tsc"""


def q_tag_keyword_weights(spark, sf):
    return scoring.tag_keyword_weights(fx.users(spark, sf))


SQL_KW = f"""WITH {sqlx.USERS}, {_kw_weights()}
SELECT user_id, feature, weight FROM kw"""


def q_dynamic_weights(spark, sf):
    hd = _hd(spark, sf)
    return scoring.dynamic_weights(full_click_counts(hd)).select("user_id", "feature", _r6("weight"))


SQL_DW = f"""{BASE}, {CLICKS}
SELECT user_id, feature, round(weight, 6) AS weight FROM dw"""


def q_negation_factor(spark, sf):
    return fx.hall_features(spark, sf).select("id", "feature", neg_expr("text").alias("factor"))


SQL_NEG = f"""{BASE}
SELECT id, feature, {_neg('text')} AS factor FROM hf13"""


# ----------------------------------------------------------------------- profiles
def q_profile_clicks(spark, sf):
    hd = _hd(spark, sf)
    return profile.click_counts(hd.actions, hd.hf3)


SQL_CLICKS = f"""{BASE}, {CLICKS}
SELECT user_id, feature, v FROM cc0"""


def q_profile_points(spark, sf):
    return points_v1(_hd(spark, sf)).select("user_id", "feature", _r6("points"))


SQL_PTS1 = f"""{BASE}, {_points(fixed.ACTION_POINTS_V1, 'pts1')}
SELECT user_id, feature, round(points, 6) AS points FROM pts1"""


def q_profile_points_v2(spark, sf):
    return points_v2(_hd(spark, sf)).select("user_id", "feature", _r6("points"))


SQL_PTS2 = f"""{BASE}, {_points(fixed.ACTION_POINTS_V2, 'pts2')}
SELECT user_id, feature, round(points, 6) AS points FROM pts2"""


def q_active_interests(spark, sf):
    """Every user starts with all thirteen counters at zero; those still at zero are not active."""
    hd = _hd(spark, sf)
    base = hd.actions.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(f) for f in F13])).alias("feature"))
    counters = base.join(points_v1(hd), ["user_id", "feature"], "left").select(
        "user_id", "feature", F.coalesce("points", F.lit(0.0)).alias("points"))
    return profile.active_interests(counters).select("user_id", "feature", _r6("points"))


def _streamed(spark, sf, features, rules):
    return streaming.streamed_profile(fx.table(spark, sf, "events"), fx.hall_features(spark, sf, features), rules)


def q_stream_clicks(spark, sf):
    return _streamed(spark, sf, F3, profile.ACTION_POINTS_CLICKS).select("user_id", "feature", F.col("points").alias("v"))


def q_stream_points(spark, sf):
    return _streamed(spark, sf, F13, fixed.ACTION_POINTS_V1).select("user_id", "feature", _r6("points"))


def q_stream_points_v2(spark, sf):
    return _streamed(spark, sf, F13, fixed.ACTION_POINTS_V2).select("user_id", "feature", _r6("points"))


SQL_ACTIVE = f"""{BASE}, {_points(fixed.ACTION_POINTS_V1, 'pts1')}
SELECT user_id, feature, round(points, 6) AS points FROM pts1 WHERE points > 0"""


# ---------------------------------------------------------------------- sentiment
def _docs(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", "aspect", "text")


def _scores(spark, sf):
    docs = _docs(spark, sf)
    lab = sentiment.stand_in_labels(docs, fx.table(spark, sf, "labels"))
    return sentiment.sentiment_scores(docs, lab, fx.DOCUMENT_ASPECTS)


def _item_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(a)} THEN {lit(c)}"
                              for a, c in zip(fx.DOCUMENT_ASPECTS, fixed.PERSONAL_COLUMNS)) + " END"


SENT = f"""WITH d AS (SELECT doc_id, lang AS aspect, coalesce(text, '') AS text, {_item_sql('lang')} AS item FROM documents),
j AS (SELECT d.*, l.quality, l.toxic FROM d LEFT JOIN labels l USING (doc_id)),
lab AS (SELECT doc_id, text, item, 'm1' AS model, CASE WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'negative' END AS label FROM j
  UNION ALL SELECT doc_id, text, item, 'm2', CASE WHEN toxic = 1 THEN 'negative' WHEN toxic = 0 THEN 'positive' END FROM j
  UNION ALL SELECT doc_id, text, item, 'm3', CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN toxic = 1 THEN 'negative'
                                              WHEN quality IS NOT NULL THEN 'neutral' END FROM j),
ss AS (SELECT doc_id, item, model, CASE WHEN length(text) < 2 OR lower(text) = 'none' THEN 0
              WHEN contains(upper(coalesce(label, '')), 'POSITIVE') THEN 2
              WHEN contains(upper(coalesce(label, '')), 'NEGATIVE') THEN -1 ELSE 0 END AS score FROM lab)"""


def q_sentiment_scores(spark, sf):
    return _scores(spark, sf)


SQL_SENT_SCORES = f"{SENT}\nSELECT doc_id, item, model, score FROM ss"


def q_score_pivot(spark, sf):
    s = _scores(spark, sf)
    return (s.groupBy("item").pivot("model", sentiment.MODELS)
            .agg(F.count_if(F.col("score") == 2).alias("pos"), F.count_if(F.col("score") == 0).alias("neu"),
                 F.count_if(F.col("score") == -1).alias("neg")))


SQL_PIVOT = f"""{SENT}
SELECT item, {', '.join(f"CAST(count_if(model = '{m}' AND score = 2) AS BIGINT) AS {m}_pos, "
                        f"CAST(count_if(model = '{m}' AND score = 0) AS BIGINT) AS {m}_neu, "
                        f"CAST(count_if(model = '{m}' AND score = -1) AS BIGINT) AS {m}_neg" for m in sentiment.MODELS)}
FROM ss GROUP BY item"""


def q_score_means(spark, sf):
    s = _scores(spark, sf)
    p = s.groupBy("item").pivot("model", sentiment.MODELS).agg(F.avg("score"))
    return p.select("item", *[F.round(m, 6).alias(m) for m in sentiment.MODELS])


SQL_MEANS = f"""{SENT}
SELECT item, {', '.join(f"round(avg(score) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in sentiment.MODELS)}
FROM ss GROUP BY item"""


def q_reason_labels(spark, sf):
    s = _scores(spark, sf)
    return s.select("doc_id", "model", sentiment.reason_label(F.col("score")).alias("reason"))


SQL_REASON = f"""{SENT}
SELECT doc_id, model, CASE WHEN score > 1 THEN {lit(fixed.REASON_GOOD)} WHEN score >= 0 THEN {lit(fixed.REASON_FAIR)}
       ELSE {lit(fixed.REASON_POOR)} END AS reason FROM ss"""


def _ref_vectors(spark, sf):
    """(model, item, rvec): reference vector of model k and item j is embedding n - 1 - (4k + j)."""
    n = fx._n_vectors(spark, sf)
    rows = [(m, c, 4 * k + j) for k, m in enumerate(sentiment.SIM_MODELS) for j, c in enumerate(fixed.PERSONAL_COLUMNS)]
    ref = spark.createDataFrame(rows, "model string, item string, off int")
    e = fx.embedding_lookup(spark, sf)
    return ref.select("model", "item", (n - 1 - F.col("off")).alias("vec_id")).join(e, "vec_id").select(
        "model", "item", F.col("vector").alias("rvec"))


def q_similarity_buckets(spark, sf):
    docs = _docs(spark, sf)
    dv = fx.embedding_lookup(spark, sf).withColumnRenamed("vec_id", "doc_id")
    return sentiment.similarity_buckets(docs, dv, _ref_vectors(spark, sf), fx.DOCUMENT_ASPECTS)


SQL_SIMB = f"""WITH {_emb()},
d AS (SELECT doc_id, coalesce(text, '') AS text, {_item_sql('lang')} AS item FROM documents),
ref(model, item, off) AS (VALUES {', '.join(f"('{m}', {lit(c)}, {4 * k + j})" for k, m in enumerate(sentiment.SIM_MODELS) for j, c in enumerate(fixed.PERSONAL_COLUMNS))}),
rv AS (SELECT r.model, r.item, e.v AS rvec FROM ref r JOIN emb e ON e.vec_id = {NVEC} - 1 - r.off),
x AS (SELECT d.doc_id, d.item, rv.model, d.text, {sql_cos('e.v', 'rv.rvec')} AS c FROM d LEFT JOIN emb e ON e.vec_id = d.doc_id JOIN rv USING (item))
SELECT doc_id, item, model, CASE WHEN length(text) < 5 OR lower(text) = 'none' THEN 0
       WHEN c > {fixed.SIMILARITY_HIGH} THEN 2 WHEN c < {fixed.SIMILARITY_LOW} THEN -1 ELSE 0 END AS score FROM x"""


def q_sentiment_prob(spark, sf):
    docs = _docs(spark, sf).join(fx.table(spark, sf, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "LABEL_1").when(F.col("quality").isNotNull(), "LABEL_0")
    prob = F.when(F.col("toxic") == 1, F.lit(0.6)).otherwise(F.lit(0.9))
    return docs.select("doc_id", F.round(sentiment.positive_probability(F.col("text"), label, prob), 6).alias("prob"))


SQL_PROB = """SELECT d.doc_id, round(CASE WHEN length(coalesce(d.text, '')) < 5 THEN 0.5::DOUBLE WHEN l.quality IS NULL THEN 0.5::DOUBLE
       WHEN l.quality = 1 THEN (CASE WHEN l.toxic = 1 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END)
       ELSE 1.0::DOUBLE - (CASE WHEN l.toxic = 1 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END) END, 6) AS prob
FROM documents d LEFT JOIN labels l USING (doc_id)"""


def q_top_plus_random(spark, sf, top: int = 10, seed: int = fixed.RANDOM_SEED):
    halls = fx.chunks(spark, sf).select("doc_id", F.col("venue_id").alias("hall_id"))
    s = sentiment.hall_totals(_scores(spark, sf).join(halls, "doc_id"))
    # three models hold a third of the rows each: the limit sits in the window (partial group limit)
    top_rows = rank_within(s, ["model"], "final_score", "hall_id", top, "pos").withColumn("part", F.lit("top"))
    rest = s.join(top_rows.select("model", "hall_id"), ["model", "hall_id"], "left_anti")
    key = F.md5(F.concat_ws(":", F.col("hall_id").cast("string"), F.lit(str(seed))))
    w = F.row_number().over(Window.partitionBy("model").orderBy(key, "hall_id"))
    rnd = (rest.withColumn("_rn", w).where(F.col("_rn") <= top)
           .withColumn("pos", F.col("_rn").cast("long")).withColumn("part", F.lit("random")))
    cols = ["model", "hall_id", F.round("final_score", 6).alias("final_score"), "part", "pos"]
    return top_rows.select(*cols).unionByName(rnd.select(*cols))


def _iw_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(c)} THEN {w}::DOUBLE" for c, w in fixed.MODEL_RANK_WEIGHTS) + \
        f" ELSE {fixed.MODEL_RANK_OTHER_WEIGHT}::DOUBLE END"


SQL_TOPRAND = f"""{SENT},
hall AS (SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS hall_id FROM documents),
f AS (SELECT hall_id, model, sum(score * {_iw_sql('item')}) AS final_score FROM ss JOIN hall USING (doc_id) GROUP BY hall_id, model),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(final_score, 9) DESC, hall_id) AS pos FROM f),
t AS (SELECT model, hall_id, final_score, 'top' AS part, pos FROM r WHERE pos <= 10),
rest AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.model = f.model AND t.hall_id = f.hall_id)),
rr AS (SELECT model, hall_id, final_score, 'random' AS part,
              row_number() OVER (PARTITION BY model ORDER BY md5(CAST(hall_id AS VARCHAR) || ':' || '{fixed.RANDOM_SEED}'), hall_id) AS pos FROM rest)
SELECT model, hall_id, round(final_score, 6) AS final_score, part, pos FROM t
UNION ALL SELECT model, hall_id, round(final_score, 6), part, pos FROM rr WHERE pos <= 10"""


def q_minmax_rank(spark, sf):
    hd = _hd(spark, sf)
    q = hd.hf13.select("id", "feature", (F.col("score") / F.lit(5.0)).alias("q"))
    food = q.where(F.col("feature") == "feat_food_quality").select("id", F.col("q").alias("food"))
    park = q.where(F.col("feature") == "feat_parking_space").select("id", F.col("q").alias("park"))
    analyzed = (hd.halls.join(food, "id", "left").join(park, "id", "left")
                .select("id", F.col("price").alias("food_price"),
                        F.coalesce("food", F.lit(0.5)).alias("food_score"),
                        F.coalesce("park", F.lit(0.5)).alias("parking_score")))
    return scoring.minmax_rank(analyzed).select("id", _r6("price_norm"), _r6("final_score"))


SQL_MINMAX = f"""{BASE},
a AS (SELECT h.id, h.price AS food_price, coalesce(fq.score / {D5}, 0.5) AS food_score, coalesce(ps.score / {D5}, 0.5) AS parking_score
      FROM halls h LEFT JOIN hf13 fq ON fq.id = h.id AND fq.feature = 'feat_food_quality'
      LEFT JOIN hf13 ps ON ps.id = h.id AND ps.feature = 'feat_parking_space'),
n AS (SELECT a.*, 1.0 - (food_price - (SELECT min(food_price) FROM a)) / ((SELECT max(food_price) FROM a) - (SELECT min(food_price) FROM a) + {fixed.MINMAX_EPS}) AS price_norm FROM a)
SELECT id, round(price_norm, 6) AS price_norm,
       round(price_norm * {fixed.MINMAX_WEIGHTS['w_price']} + food_score * {fixed.MINMAX_WEIGHTS['w_food']}
             + parking_score * {fixed.MINMAX_WEIGHTS['w_parking']}, 6) AS final_score FROM n"""


REGISTRY = {
    "rec_weighted_sim": (q_rec_weighted_sim, SQL_R1),
    "rec_quality": (q_rec_quality, SQL_R2),
    "rec_base_plus": (q_rec_base_plus, SQL_R3),
    "rec_match_rate": (q_rec_match_rate, SQL_R4),
    "rec_profile": (q_rec_profile, SQL_R5),
    "rec_tags_clicks": (q_rec_tags_clicks, SQL_R6),
    "rec_ordered_tags": (q_rec_ordered_tags, SQL_R7),
    "matched_discovery": (q_matched_discovery, SQL_MD),
    "rec_behaviour": (q_rec_behaviour, SQL_R8),
    "rec_integrated": (q_rec_integrated, SQL_R10),
    "rec_half_half": (q_rec_half_half, SQL_R11),
    "tag_vector_rank": (q_tag_vector_rank, SQL_R12),
    "pref_score": (q_pref_score, SQL_PREF),
    "tag_scores": (q_tag_scores, SQL_TAG_SCORES),
    "tag_keyword_weights": (q_tag_keyword_weights, SQL_KW),
    "dynamic_weights": (q_dynamic_weights, SQL_DW),
    "negation_factor": (q_negation_factor, SQL_NEG),
    "profile_clicks": (q_profile_clicks, SQL_CLICKS),
    "profile_points": (q_profile_points, SQL_PTS1),
    "profile_points_v2": (q_profile_points_v2, SQL_PTS2),
    "active_interests": (q_active_interests, SQL_ACTIVE),
    "stream_clicks": (q_stream_clicks, SQL_CLICKS),
    "stream_points": (q_stream_points, SQL_PTS1),
    "stream_points_v2": (q_stream_points_v2, SQL_PTS2),
    "sentiment_scores": (q_sentiment_scores, SQL_SENT_SCORES),
    "score_pivot": (q_score_pivot, SQL_PIVOT),
    "score_means": (q_score_means, SQL_MEANS),
    "reason_labels": (q_reason_labels, SQL_REASON),
    "similarity_buckets": (q_similarity_buckets, SQL_SIMB),
    "sentiment_prob": (q_sentiment_prob, SQL_PROB),
    "top_plus_random": (q_top_plus_random, SQL_TOPRAND),
    "minmax_rank": (q_minmax_rank, SQL_MINMAX),
}
