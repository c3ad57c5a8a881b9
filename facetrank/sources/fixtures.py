"""Driver tables mapped onto the roles of the review engine.

The mappings are stand-ins (see README): they exercise each operator on data
whose size grows with the scale factor.  Every function returns a lazy
DataFrame; column pruning and filters reach the Parquet scan.

Roles
-----
chunks          documents: venue = number in ``source``, aspect = ``lang``
queries         benchmark: one query per ``item_id``
vectors         embeddings: aspect = ``label``
chunk vectors   chunks joined to embeddings on ``doc_id = vec_id``
query vectors   benchmark joined to embeddings on ``item_id = vec_id``
halls           part: location = brand, hall type = type, price = retail price
hall features   13 features per hall, present or absent by a rule on the key,
                quality 1..5 from size and key, vectors from embeddings
users           events: preferences taken from the user's first event
actions         events: click, view -> stay, purchase -> like, signup -> survey
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import R1_WEIGHTS, REGION_KEYWORDS, STOPWORDS, TAG_MAP, VIBE_FLAGS

DOCUMENT_ASPECTS = ["de", "en", "es", "fr"]
HALL_FEATURES_3 = ["feat_parking", "feat_food", "feat_mood"]
HALL_FEATURES_13 = [feature for _, feature in TAG_MAP]


# Notes that reviewers leave, in the language of the keyword lists (the given texts hold none of those words).  A row
# gets one by an md5 of its key, so that SQL can follow; the first is no note.
REVIEW_NOTES = ["", *[f" {words[0]} 홀." for _, words in VIBE_FLAGS],
                " 식대 65,000원 대관료 300만원. 주차 편리.", " 뷔페 음식 맛있음. 셔틀 운행.", f" {' '.join(STOPWORDS)} 식대 7만.", " 대관료 무료."]
PLACE_NOTES = ["", *[f" {words[0]}" for _, words in REGION_KEYWORDS]]
FEATURE_NOTES = ["", "조금 협소", "넓고 쾌적", ""]


def note_of(notes: list[str], salt: str, key: Column | str) -> Column:
    """The note of a row: notes[h mod n], h the first four hex digits of md5("salt:key")."""
    key = (F.col(key) if isinstance(key, str) else key).cast("string")
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key)), 1, 4), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in notes]), F.pmod(h, F.lit(len(notes))) + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------- retrieval
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long review-chunk table: doc_id, venue_id, hall_name, aspect, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("venue_id"),
        F.col("source").alias("hall_name"),
        F.col("lang").alias("aspect"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def noted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, each text with its reviewer's note."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("text", F.concat("text", note_of(REVIEW_NOTES, "d", "doc_id")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    F.coalesce(F.col("text"), F.lit("")).alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector table: doc_id, aspect (label as text), vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"),
                    F.col("label").cast("string").alias("aspect"),
                    F.col("embedding").alias("vector"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense index of the chunks: chunks that have a stored vector."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return chunks(spark, sf_dir).select("doc_id", "aspect").join(e, "doc_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return queries(spark, sf_dir).select("query_id").join(e, "query_id")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per venue with its name (first name by value)."""
    return (chunks(spark, sf_dir).groupBy("venue_id")
            .agg(F.min("hall_name").alias("hall_name")))


# ---------------------------------------------------------------------- halls
def _n_vectors(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "embeddings").select(F.count(F.lit(1))).scalar()


def halls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("location"),
        F.col("p_type").alias("hall_type"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
    )


def halls_wide(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> DataFrame:
    """Wide halls: id, name, location, hall_type, price, size, then per feature
    ``feat_x`` (text) and ``x_score`` (1..5).

    Feature ``i`` of hall ``id`` is present unless ``p % 3 = 0`` (the sparse
    form: absent features are null); its text is the hall name and type and a note, its
    quality ``1 + q % 5``.  ``p`` and ``q`` are the first four hex digits of
    ``md5("p:id:i")`` and ``md5("q:id:size:i")``: presence and quality are
    independent across features (md5 so that the SQL oracle can follow).
    """
    from ..operators.reshape import score_column
    features = features or HALL_FEATURES_13
    # a small file makes thirteen times as many rows: all cores make them
    h = halls(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    cols = []
    for i, f in enumerate(features):
        ph = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("p"), F.col("id").cast("string"), F.lit(str(i)))),
                                1, 4), 16, 10).cast("int")
        present = F.pmod(ph, F.lit(3)) != 0
        note = note_of(FEATURE_NOTES, "n", F.concat_ws(":", F.col("id").cast("string"), F.lit(str(i))))
        cols.append(F.when(present, F.concat_ws(" ", "name", F.lower("hall_type"), F.nullif(note, F.lit("")))).alias(f))
        qh = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("q"), F.col("id").cast("string"), F.col("size").cast("string"),
                                                    F.lit(str(i)))), 1, 4), 16, 10).cast("int")
        cols.append(F.when(present, F.lit(1) + F.pmod(qh, F.lit(5))).cast("int").alias(score_column(f)))
    return h.select("*", *cols)


def hall_features(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> DataFrame:
    """Long hall features: id, feature, fidx, text, score, vec_id (``(id * 13 + i) mod n``)."""
    from ..operators.reshape import unpivot_features
    features = features or HALL_FEATURES_13
    n = _n_vectors(spark, sf_dir)
    return (unpivot_features(halls_wide(spark, sf_dir, features), features)
            .withColumn("vec_id", F.pmod(F.col("id") * 13 + F.col("fidx"), n)))


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("embedding").alias("vector"))


# ---------------------------------------------------------------------- users
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action stream: event_id, ts, user_id, hall_id, action, stay_time."""
    e = table(spark, sf_dir, "events")
    action = (F.when(F.col("event_type") == "click", "click")
              .when(F.col("event_type") == "view", "stay")
              .when(F.col("event_type") == "purchase", "like")
              .when(F.col("event_type") == "signup", "survey")
              .otherwise("none"))
    return e.select(
        "event_id", "ts", "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("hall_id"),
        action.alias("action"),
        F.col("value").alias("stay_time"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User preferences: the hall of the user's first event anchors the filters.

    user_id, location, hall_type, max_price, selected_tags (3 ordered display
    tags), raw_query (anchor hall name), query_vec_id, priorities (feature ->
    weight: the scenario's weights, dealt to the features and scaled by the user's id).
    """
    a = actions(spark, sf_dir)
    first = a.groupBy("user_id").agg(F.min_by("hall_id", "event_id").alias("anchor"))
    h = halls(spark, sf_dir).select(
        F.col("id").alias("anchor"), "location", "hall_type", F.col("price").alias("max_price"),
        F.col("name").alias("raw_query"))
    tags = F.array(*[F.lit(t) for t, _ in TAG_MAP])
    pick = [F.element_at(tags, (F.pmod(F.col("user_id") + 5 * j, F.lit(13)) + 1).cast("int"))
            for j in range(3)]
    n = _n_vectors(spark, sf_dir)
    base = F.array(*[F.lit(w) for _, w in R1_WEIGHTS])
    own = [F.element_at(base, (F.pmod(F.col("user_id") + i, F.lit(3)) + 1).cast("int"))
           * (F.lit(1.0) + F.pmod(F.col("user_id"), F.lit(4)) * F.lit(0.25)) for i in range(3)]
    priorities = F.map_from_arrays(F.array(*[F.lit(f) for f in HALL_FEATURES_3]), F.array(*own))
    # the bytes of the files say little of the rows in them: no side is sent through the driver on their word
    return (first.join(h.hint("merge"), "anchor")
            .select("user_id", "location", "hall_type", "max_price",
                    F.array(*pick).alias("selected_tags"), "raw_query",
                    F.pmod(F.col("user_id"), n).alias("query_vec_id"), priorities.alias("priorities")))
