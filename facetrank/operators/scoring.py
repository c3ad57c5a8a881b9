"""One parametrised preference scorer and its configurations (R1..R14).

Every recommender is: hard filter (an equi-join of users and halls), then
``sum over features of sim x weight x quality/5 x negation``, then a sort.
The terms differ per configuration; they are column expressions over long
tables (user, feature, weight) and (hall, feature, text, score, vector).

Similarity is cosine between stored vectors (``functions.vectors``): the
user's query vector, the display tag's vector and each hall feature's vector
are rows of the embeddings table, joined by id, never re-encoded per request.

Orders are score descending, then hall id.  Configurations that rank every
hall per user (R7/R10 discovery fill, R8) use ``topk.weighted_topk`` so that
no user x hall product is formed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import negation_factor
from ..functions.vectors import cosine
from ..sources import fixtures as fx
from ..sources.files import stored
from .lexical import RANK_DIGITS, rank_within
from .lists import By, half_up, ranked_pairs
from .pairs import counted, scored_pairs
from .topk import weighted_topk


@dataclass
class HallData:
    halls: DataFrame        # id, name, location, hall_type, price, size
    hf3: DataFrame          # id, feature, fidx, text, score, vec_id  (3 features)
    hf13: DataFrame         # same over the 13 tag features
    vectors: DataFrame      # vec_id, vector
    users: DataFrame        # user_id, location, hall_type, max_price, selected_tags, raw_query, query_vec_id
    actions: DataFrame      # event_id, ts, user_id, hall_id, action, stay_time
    n_vectors: Column       # scalar: rows of the embeddings table

    @classmethod
    def from_sf(cls, spark: SparkSession, sf: str) -> "HallData":
        return cls(fx.halls(spark, sf), fx.hall_features(spark, sf, fx.HALL_FEATURES_3),
                   fx.hall_features(spark, sf), fx.embedding_lookup(spark, sf), fx.users(spark, sf),
                   fx.actions(spark, sf), fx._n_vectors(spark, sf))


# ------------------------------------------------------------------ building blocks
def tag_map(spark: SparkSession) -> DataFrame:
    """tag, feature, tag_index (fixed 13-row dimension)."""
    return spark.createDataFrame([(t, f, i) for i, (t, f) in enumerate(fixed.TAG_MAP)],
                                 "tag string, feature string, tag_index int")


def position_weight(pos: Column) -> Column:
    w = fixed.TAG_POSITION_WEIGHTS
    expr = F.when(pos == 0, F.lit(w[0]))
    for i in range(1, len(w)):
        expr = expr.when(pos == i, F.lit(w[i]))
    return expr.otherwise(F.lit(fixed.TAG_POSITION_DEFAULT))


def tag_scores(users: DataFrame, spark: SparkSession) -> DataFrame:
    """user_id, pos, tag, feature, tag_index, weight (3/1.5/1 then 1), inv_weight (1/(pos+1)).

    Tags unknown to the tag map are dropped but keep their position."""
    tp = users.select("user_id", F.posexplode("selected_tags").alias("pos", "tag"))
    return (tp.join(F.broadcast(tag_map(spark)), "tag")
            .select("user_id", F.col("pos").cast("long").alias("pos"), "tag", "feature", "tag_index",
                    position_weight(F.col("pos")).alias("weight"),
                    (F.lit(1.0) / (F.col("pos") + 1)).alias("inv_weight")))


def tag_keyword_weights(users: DataFrame) -> DataFrame:
    """user_id, feature, weight: 1.0 + 2.0 per selected tag holding a keyword of the feature."""
    tags = F.coalesce(F.col("selected_tags"), F.array().cast("array<string>"))
    cols = []
    for feature, words in fixed.TAG_KEYWORDS:
        hits = F.size(F.filter(tags, _matcher(words)))
        cols.append(F.struct(F.lit(feature).alias("feature"),
                             (F.lit(fixed.TAG_KEYWORD_BASE) + F.lit(fixed.TAG_KEYWORD_BONUS) * hits).alias("weight")))
    return users.select("user_id", F.explode(F.array(*cols)).alias("w")).select("user_id", "w.feature", "w.weight")


def _matcher(words: list[str]):
    return lambda t: _any(t, words)


def _any(t: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(t, F.lit(w))
    return cond


def dynamic_weights(counts: DataFrame) -> DataFrame:
    """user_id, feature, weight = 1 + 5 * v / total per user; a zero total gives 1.0."""
    total = F.sum("v").over(Window.partitionBy("user_id"))
    return counts.select("user_id", "feature", F.when(total == 0, F.lit(1.0))
                         .otherwise(F.lit(1.0) + F.col("v") / total * F.lit(fixed.DYNAMIC_SCALE)).alias("weight"))


@dataclass
class Filtered:
    """The two sides of a hard filter; its pairs are made where they are scored."""
    users: DataFrame      # user_id, keys, _times (rows alike), _ceiling (if prices count)
    halls: DataFrame      # id, keys, _copies, price
    keys: list[str]

    def scored(self, weights: DataFrame | None = None, terms: DataFrame | None = None, **options) -> DataFrame:
        return scored_pairs(self.users, self.halls, self.keys, None if weights is None else _weight_maps(weights), terms, **options)

    def ranked(self, weights: DataFrame | None, terms: DataFrame | None, by: By | None = None, **options) -> DataFrame:
        """Best first per user, users in order; by: what a list is ranked by (the score, if not given)."""
        terms = None if terms is None else stored(terms, "hall-terms")
        return ranked_pairs(self.users, self.halls, self.keys, None if weights is None else _weight_maps(weights), terms,
                            by or (lambda score, base, user: score), **options)

    def with_users(self, more: DataFrame, how: str = "inner") -> "Filtered":
        return replace(self, users=self.users.join(more.hint("merge"), "user_id", how))

    def repeated(self) -> "Filtered":
        """Each row as often as there are rows alike: pairs as a join of two results on the pairs makes them."""
        more = lambda x, c: x.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).drop("_i")
        return replace(self, users=more(self.users, "_times"), halls=more(self.halls, "_copies"))

    def with_halls(self, more: DataFrame) -> "Filtered":
        return replace(self, halls=self.halls.join(more.hint("merge"), "id"))


def hard_filter(users: DataFrame, halls: DataFrame, with_type: bool = True, with_price: bool = True) -> Filtered:
    """(user_id, id) pairs: same location, price at most the budget (and same hall type), as the two sides of their join."""
    keys = ["location", *(["hall_type"] if with_type else [])]
    cap = [F.col("max_price").alias("_ceiling")] if with_price else []
    u, h = users.select("user_id", *keys, *cap), halls.select("id", *keys, *(["price"] if with_price else []))
    return Filtered(counted(u, u.columns, "_times"), counted(h, h.columns, "_copies"), keys)


def _weight_maps(weights: DataFrame) -> DataFrame:
    """user_id, w: feature -> weight, summed per feature."""
    w = weights.columns[-1]
    return (weights.where(F.col("feature").isNotNull()).groupBy("user_id", "feature").agg(F.sum(w).alias("w"))
            .groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("w")))


def _hall_terms(hf: DataFrame, q: Column, *more: str) -> DataFrame:
    """id, terms: the hall's features with a factor each (and a vector, if named)."""
    return hf.groupBy("id").agg(F.collect_list(F.struct("feature", q.cast("double").alias("q"), *more)).alias("terms"))


def _vec(vectors: DataFrame, key: str, name: str) -> DataFrame:
    return vectors.select(F.col("vec_id").alias(key), F.col("vector").alias(name))


def user_vectors(hd: HallData) -> DataFrame:
    return hd.users.select("user_id", "query_vec_id").join(_vec(hd.vectors, "query_vec_id", "uvec"), "query_vec_id")


def hall_vectors(hd: HallData) -> DataFrame:
    """id, hvec: the hall's review vector is embedding ``id mod n``."""
    return (hd.halls.select("id", F.pmod(F.col("id"), hd.n_vectors).alias("hv_id"))
            .join(_vec(hd.vectors, "hv_id", "hvec"), "hv_id").drop("hv_id"))


def _own_vectors(hd: HallData) -> DataFrame:
    return user_vectors(hd).groupBy("user_id").agg(F.collect_list("uvec").alias("us"))


def _quality(quality: bool) -> Column:
    return F.col("score") / F.lit(5.0) if quality else F.lit(1.0)


def feature_similarity(pairs: Filtered, weights: DataFrame, hf: DataFrame, hd: HallData, quality: bool = True) -> DataFrame:
    """user_id, id, score = sum over the hall's present features of cos(user, feature) x w (x q/5).

    pairs: a hard filter; weights: (user_id, feature, weight).  Pairs whose hall
    has none of the weighted features score 0."""
    terms = _hall_terms(hf.select("id", "feature", "score", "vec_id").join(_vec(hd.vectors, "vec_id", "v"), "vec_id"),
                        _quality(quality), "v")
    return pairs.scored(weights, terms, vectors=_own_vectors(hd))


def ranked_similarity(pairs: Filtered, weights: DataFrame, hf: DataFrame, hd: HallData, quality: bool = True,
                      base: str | None = None, by: By | None = None) -> DataFrame:
    """``feature_similarity`` as whole lists, best first per user.  With base ("dot", "cosine") also the product of uvec and
    hvec, if the pairs carry them."""
    terms = _hall_terms(hf.select("id", "feature", "score", "vec_id"), _quality(quality), "vec_id")
    return pairs.ranked(weights, terms, by, vectors=_own_vectors(hd), term_vectors=hd.vectors, base=base)


def _fixed_weights(users: DataFrame, weights: list[tuple[str, float]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("weight")) for f, w in weights])
    return users.select("user_id", F.explode(arr).alias("w")).select("user_id", "w.feature", "w.weight")


def user_priorities(users: DataFrame, default: list[tuple[str, float]] = fixed.R1_WEIGHTS) -> DataFrame:
    """user_id, feature, weight: each user's own priorities; ``default`` for a user without any."""
    if "priorities" not in users.columns:
        return _fixed_weights(users, default)
    given = F.map_from_arrays(F.array(*[F.lit(f) for f, _ in default]), F.array(*[F.lit(w) for _, w in default]))
    own = F.when(F.size("priorities") > 0, F.col("priorities")).otherwise(given)
    return users.select("user_id", F.explode(own).alias("feature", "weight"))


def weights_text(weights: DataFrame) -> DataFrame:
    """user_id, weights: ``feature=weight`` of each feature, in order of the features."""
    one = F.struct("feature", "weight")
    shown = F.transform(F.sort_array(F.collect_list(one)), lambda w: F.format_string("%s=%.4f", w["feature"], w["weight"]))
    return weights.groupBy("user_id").agg(F.array_join(shown, ",").alias("weights"))


# --------------------------------------------------------------- R1 .. R6 (filtered)
def rec_weighted_sim(hd: HallData) -> DataFrame:
    pairs = hard_filter(hd.users, hd.halls, with_type=False)
    return ranked_similarity(pairs, user_priorities(hd.users), hd.hf3, hd, quality=False)


def rec_quality(hd: HallData) -> DataFrame:
    pairs = hard_filter(hd.users, hd.halls, with_type=False).with_halls(hd.halls.select("id", "name"))
    return ranked_similarity(pairs, user_priorities(hd.users), hd.hf3, hd)


def rec_base_plus(hd: HallData, nested: DataFrame) -> DataFrame:
    """Location filter on the nested metadata; cos(user, hall) + sum cos(user, feature) x priority."""
    halls = nested.select("id", F.col("metadata.location").alias("location"))
    pairs = hard_filter(hd.users, halls, with_type=False, with_price=False).repeated()
    pairs = pairs.with_users(user_vectors(hd).select("user_id", "uvec")).with_halls(hall_vectors(hd))
    s = ranked_similarity(pairs, user_priorities(hd.users, fixed.R3_PRIORITIES), hd.hf3, hd, quality=False, base="cosine",
                          by=lambda score, base, user: base + score)
    return s.select("user_id", "id", (F.col("base") + F.col("score")).alias("score"))


def rec_match_rate(hd: HallData) -> DataFrame:
    """Score in percent of the sum of the user's own priorities."""
    own = user_priorities(hd.users)
    pairs = hard_filter(hd.users, hd.halls).with_users(own.groupBy("user_id").agg(F.sum("weight").alias("total")))
    # a missing sum of priorities leaves every rate of the user null
    s = ranked_similarity(pairs, own, hd.hf3, hd, by=lambda score, base, user: score / user["total"] * 100.0 if user["total"] else 0.0 * score)
    return s.withColumn("match_rate", F.col("score") / F.col("total") * F.lit(100.0)).drop("total")


def rec_profile(hd: HallData, click_counts: DataFrame) -> DataFrame:
    w = dynamic_weights(click_counts)
    pairs = hard_filter(hd.users, hd.halls).with_users(weights_text(w), "left")
    return ranked_similarity(pairs, w, hd.hf3, hd)


def tags_clicks_weights(hd: HallData, click_counts: DataFrame) -> DataFrame:
    base = tag_keyword_weights(hd.users)
    c = click_counts.select("user_id", "feature", "v")
    return (base.join(c, ["user_id", "feature"], "left")
            .select("user_id", "feature",
                    (F.col("weight") + F.lit(fixed.CLICK_BONUS) * F.coalesce("v", F.lit(0.0))).alias("weight")))


def rec_tags_clicks(hd: HallData, click_counts: DataFrame) -> DataFrame:
    w = tags_clicks_weights(hd, click_counts)
    pairs = hard_filter(hd.users, hd.halls).with_users(weights_text(w), "left")
    return ranked_similarity(pairs, w, hd.hf3, hd)


# ------------------------------------------------------ R7 .. R10 (ordered tags)
def tag_terms(hd: HallData, kind: str) -> DataFrame:
    """id, feature, t for the 13 tag features.

    ordered:    cos(tag, feature) x q/5
    behaviour:  0.8 x q/5
    integrated: cos(tag, feature) x q/5 x negation factor of the feature text
    Features with an empty text are skipped, as in the reviewed scorer."""
    spark = hd.halls.sparkSession
    hf = hd.hf13.where(F.col("text").isNotNull() & (F.regexp_replace("text", r"^\s+|\s+$", "") != ""))
    q = F.col("score") / F.lit(5.0)
    if kind == "behaviour":
        return hf.select("id", "feature", (F.lit(fixed.FIXED_SIM_R8) * q).alias("t"))
    # the thirteen tags, one value of the plan, meet each stored vector once; the features then take their number from it
    tags = (tag_map(spark).select("feature", "tag_index")
            .join(_vec(hd.vectors, "tag_index", "tvec").where(F.col("tag_index") < len(fixed.TAG_MAP)), "tag_index"))
    every = tags.agg(F.collect_list(F.struct("feature", "tvec")).alias("tags")).scalar()
    sims = _vec(hd.vectors, "vec_id", "fvec").withColumn("tag", F.explode(every)).select(
        "vec_id", "tag.feature", cosine("tag.tvec", "fvec").alias("sim"))
    x = hf.join(sims, ["vec_id", "feature"])
    t = F.col("sim") * q
    if kind == "integrated":
        t = t * negation_factor("text")
    return x.select("id", "feature", t.alias("t"))


def tag_user_weights(hd: HallData, points: DataFrame | None = None, bonus: float = 0.0) -> DataFrame:
    """user_id, feature, a = position weight (+ bonus x points of the feature)."""
    spark = hd.halls.sparkSession
    ts = tag_scores(hd.users, spark).select("user_id", "feature", F.col("weight").alias("a"))
    if points is None:
        return ts
    p = points.select("user_id", "feature", "points")
    return (ts.join(p, ["user_id", "feature"], "left")
            .select("user_id", "feature",
                    (F.col("a") + F.lit(bonus) * F.coalesce("points", F.lit(0.0))).alias("a")))


def _score_pairs(pairs: Filtered, uw: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Each user's first n of the pairs: user_id, id, score, rank."""
    return pairs.scored(uw, _hall_terms(terms, F.col("t")), n=n)


NO_TAG = "_no_tag"  # a feature that no hall has: users without a known tag get it, and so zero scores


def with_untagged(hd: HallData, uw: DataFrame) -> DataFrame:
    """The weights with a row for every user that has none."""
    return hd.users.select("user_id").distinct().join(uw, "user_id", "left").select(
        "user_id", F.coalesce("feature", F.lit(NO_TAG)).alias("feature"), F.coalesce("a", F.lit(1.0)).alias("a"))


def matched_then_discovery(hd: HallData, uw: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Matched halls (hard filter) first, then the best of the rest: user_id, id, matched, score, rank.

    What both halves read is written first.  As kept frames nested in each other, each named by counts and joins of the next,
    they made the text of the plan, which the driver holds for every stage, grow without end."""
    terms, uw = stored(terms, "tag-terms"), stored(uw, "tag-weights")
    matched = stored(_score_pairs(hard_filter(hd.users, hd.halls), uw, terms, n), "matched")
    # a user with n matches takes no other; the matches of all others are all in ``matched``, fewer than n
    full = matched.where(F.col("rank") >= n).select("user_id").distinct()
    every = with_untagged(hd, uw).join(full, "user_id", "left_anti")
    disc = weighted_topk(every, terms, hd.halls.select("id"), 2 * n, keep=stored).drop("rank").join(
        matched.select("user_id", "id"), ["user_id", "id"], "left_anti").withColumn("matched", F.lit(False))
    matched = matched.withColumn("matched", F.lit(True))
    both = matched.select("user_id", "id", "matched", "score").unionByName(disc.select("user_id", "id", "matched", "score"))
    w = Window.partitionBy("user_id").orderBy(F.col("matched").desc(), F.round("score", RANK_DIGITS).desc(), F.col("id"))
    return (both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
            .withColumn("rank", F.col("_rn").cast("long")).drop("_rn"))


def rec_ordered_tags(hd: HallData, n: int = 10) -> DataFrame:
    return matched_then_discovery(hd, tag_user_weights(hd), tag_terms(hd, "ordered"), n)


def rec_behaviour(hd: HallData, points: DataFrame, n: int = 10, nan_policy: str = "skip") -> DataFrame:
    """All halls, no filter: 0.8 x q/5 x (position weight + 0.1 x points).

    nan_policy 'skip' ignores a missing feature; 'propagate' leaves the score of
    a hall missing any tag feature undefined (null), ranked after all others
    by id, as a NaN sum would."""
    uw = tag_user_weights(hd, points, fixed.BEHAVIOUR_BONUS_R8)
    terms = tag_terms(hd, "behaviour")
    items = hd.halls.select("id")
    every = with_untagged(hd, uw)
    if nan_policy == "skip":
        return weighted_topk(every, terms, items, n)
    # a missing feature weighs -1e15, more than any sum of points: complete halls always rank first
    big = 1e15
    full = weighted_topk(every, _with_missing_penalty(terms, items, uw, big), items, n)
    complete = full.where(F.col("score") > -big / 10)
    n_complete = complete.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    # fill: the first 2n halls by id hold at least n halls that are not complete for the user
    first_ids = [r["id"] for r in items.orderBy("id").limit(2 * n).collect()]  # a bounded top-k
    need = uw.select("user_id").distinct().join(n_complete, "user_id", "left").fillna(0, ["k"])
    cand = need.where(F.col("k") < n).select(
        "user_id", "k", F.explode(F.array(*[F.lit(i).cast("long") for i in first_ids])).alias("id"))
    uf = uw.groupBy("user_id").agg(F.count(F.lit(1)).alias("nf"))
    have = (cand.join(uw, "user_id").join(terms.select("id", "feature"), ["id", "feature"])
            .groupBy("user_id", "id").agg(F.count(F.lit(1)).alias("nh")))
    incomplete = (cand.join(uf, "user_id").join(have, ["user_id", "id"], "left")
                  .where(F.coalesce("nh", F.lit(0)) < F.col("nf")).select("user_id", "id", "k"))
    w = Window.partitionBy("user_id").orderBy("id")
    fill = (incomplete.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n - F.col("k"))
            .select("user_id", "id", F.lit(None).cast("double").alias("score"),
                    (F.col("k") + F.col("_r")).cast("long").alias("rank")))
    return complete.select("user_id", "id", "score", "rank").unionByName(fill)


def _with_missing_penalty(terms: DataFrame, items: DataFrame, uw: DataFrame, big: float) -> DataFrame:
    feats = [r["feature"] for r in uw.select("feature").distinct().collect()]
    pairs = items.select("id", F.explode(F.array(*[F.lit(f) for f in feats])).alias("feature"))
    absent = pairs.join(terms.select("id", "feature"), ["id", "feature"], "left_anti").withColumn("t", F.lit(-big))
    return terms.unionByName(absent)


def rec_integrated(hd: HallData, points: DataFrame, n: int = 10) -> DataFrame:
    uw = tag_user_weights(hd, points, fixed.BEHAVIOUR_BONUS_R9)
    return matched_then_discovery(hd, uw, tag_terms(hd, "integrated"), n)


# ------------------------------------------------------------- R11, R12, R14
# names of three tags in the half/half scorer, and their features (this repository's choice)
HALF_HALF_TAGS = [("주차 편리", "parking", "feat_parking_space"),
                  ("고급스러운 요리가 있는", "food", "feat_food_quality"),
                  ("역 접근성", "access", "feat_subway_access")]


def half_half_tags(hd: HallData) -> DataFrame:
    """user_id, feature, weight of the user's tags: the named ones weigh what the scorer gives them, all others little."""
    spark = hd.halls.sparkSession
    weights = dict(fixed.HALF_HALF_WEIGHTS)
    named = {t: (f, weights.get(nm, fixed.HALF_HALF_UNKNOWN)) for t, nm, f in HALF_HALF_TAGS}
    every = {t: (f, fixed.HALF_HALF_UNKNOWN) for t, f in fixed.TAG_MAP} | named
    tags = spark.createDataFrame([(t, f, w) for t, (f, w) in every.items()], "tag string, feature string, weight double")
    return hd.users.select("user_id", F.explode("selected_tags").alias("tag")).join(tags, "tag").select("user_id", "feature", "weight")


def rec_half_half(hd: HallData) -> DataFrame:
    """0.5 x dot(user, hall) (not normalised) + 0.5 x sum tag score x {.6, .3, .1} over P6 pairs."""
    pairs = hard_filter(hd.users, hd.halls).with_users(user_vectors(hd).select("user_id", "uvec")).with_halls(hall_vectors(hd))
    s = pairs.ranked(half_half_tags(hd), _hall_terms(hd.hf13, F.col("score") / F.lit(5.0)),
                     lambda score, base, user: fixed.HALF_SHARE * base + fixed.HALF_SHARE * score, base="dot")
    return s.select("user_id", "id", (F.lit(fixed.HALF_SHARE) * F.col("base")
                                      + F.lit(fixed.HALF_SHARE) * F.col("score")).alias("final_score"))


def rec_tag_vector(hd: HallData, types: DataFrame) -> DataFrame:
    """Type in the user's list; 0.4 x cos(user, hall) + 0.6 x sum feature value / (pos + 1); 4 places."""
    spark = hd.halls.sparkSession
    # a user row a preferred type: the filter is an equi-join on location and type
    u = hd.users.join(types, "user_id").select("user_id", "location", F.explode("types").alias("hall_type"), "max_price")
    reason = F.when(F.size("selected_tags") > 0,
                    F.concat(F.element_at("selected_tags", 1), F.lit(fixed.MATCH_REASON_SUFFIX))).otherwise(F.lit(""))
    pairs = (hard_filter(u, hd.halls).with_users(user_vectors(hd).select("user_id", "uvec")).with_halls(hall_vectors(hd))
             .with_users(hd.users.select("user_id", reason.alias("match_reason"))))
    ts = tag_scores(hd.users, spark).select("user_id", "feature", F.col("inv_weight").alias("weight"))
    s = pairs.ranked(ts, _hall_terms(hd.hf13, F.col("score") / F.lit(5.0)), base="cosine", by=lambda score, base, user: half_up(
        fixed.VECTOR_SHARE_R12 * base + fixed.TAG_SHARE_R12 * score, 4))
    return s.select("user_id", "id", F.round(F.lit(fixed.VECTOR_SHARE_R12) * F.col("base")
                                            + F.lit(fixed.TAG_SHARE_R12) * F.col("score"), 4).alias("score"), "match_reason")


def minmax_rank(analyzed: DataFrame, weights: dict[str, float] = fixed.MINMAX_WEIGHTS) -> DataFrame:
    """price_norm = 1 - (x - min) / (max - min + 1e-5) over the whole frame, then a weighted sum.

    min and max are one scalar subquery (one global aggregate), not a join."""
    ends = analyzed.agg(F.struct(F.min("food_price").alias("lo"), F.max("food_price").alias("hi"))).scalar()
    norm = F.lit(1.0) - (F.col("food_price") - ends["lo"]) / (ends["hi"] - ends["lo"] + F.lit(fixed.MINMAX_EPS))
    return (analyzed.withColumn("price_norm", norm)
            .withColumn("final_score", F.col("price_norm") * weights["w_price"]
                        + F.col("food_score") * weights["w_food"] + F.col("parking_score") * weights["w_parking"]))

