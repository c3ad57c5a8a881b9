"""Registered queries for sources, sinks, reshaping and text functions.

Each entry is ``key -> (spark_callable, duckdb_sql)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as tx
from ..operators import encode, pairs, reshape, upsert
from ..session import shared_path
from ..sources import files, html
from ..sources import fixtures as fx
from . import sqlx
from .oracle import CHUNKS, CVEC_TEXT
from .sqlx import lit

WORD_PATTERN = r"\p{L}{2,}"  # parameter of the word counts (the reference uses Hangul words)
ASPECT_PARAM = "en"
PATCH_SCHEMA = "id long, patched long"


# ----------------------------------------------------------------------- html
def q_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract_articles(fx.table(spark, sf, "pages"))


def _sql_field(h: str, pattern: str, default: str) -> str:
    val = sqlx.collapse(sqlx.decode(sqlx.strip_tags(f"regexp_extract({h}, {lit(pattern)}, 1)")))
    return f"CASE WHEN regexp_matches({h}, {lit(pattern)}) AND {val} <> '' THEN {val} ELSE {lit(default)} END"


_BODY = sqlx.collapse(sqlx.decode(sqlx.strip_tags(
    "regexp_replace(regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<h1[^>]*>.*?</h1>', ' ')")))

SQL_HTML_EXTRACT = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages)
SELECT page_id,
       {_sql_field('h', '(?s)<h1[^>]*>(.*?)</h1>', fixed.DEFAULT_TITLE)} AS title,
       {_sql_field('h', '(?s)class="nickname"[^>]*>(.*?)<', fixed.DEFAULT_AUTHOR)} AS author,
       {_sql_field('h', '(?s)<time[^>]*>(.*?)</time>', fixed.DEFAULT_DATE)} AS date,
       url,
       CASE WHEN contains(h, '<article') AND {_BODY} <> '' THEN {_BODY} ELSE {lit(fixed.DEFAULT_CONTENT)} END AS content
FROM p"""


def q_html_keep_articles(spark, sf):
    return html.keep_articles(fx.table(spark, sf, "pages")).select("page_id", "url")


SQL_HTML_KEEP = "SELECT page_id, url FROM pages WHERE coalesce(contains(html, '<article'), false)"


def q_url_absolutise(spark, sf):
    return html.absolute_links(fx.table(spark, sf, "pages"))


SQL_URL_ABS = f"""WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS hs FROM pages),
e AS (SELECT page_id, unnest(range(len(hs))) AS pos, unnest(hs) AS href FROM l)
SELECT page_id, pos, href, CASE WHEN contains(href, 'https') THEN href ELSE {lit(fixed.LINK_BASE)} || href END AS url FROM e"""


# ------------------------------------------------------------------ csv / parquet
DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def q_csv_roundtrip(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = shared_path(spark, "documents-csv")
    files.write_csv(d, path, header=True)
    return files.read_csv(spark, path, DOC_SCHEMA, header=True)


SQL_CSV = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def _chunk_vector_table(spark, sf) -> DataFrame:
    c = fx.chunks(spark, sf)
    # index row id "{venue}_{aspect}_{row}" over a stable key (the chunk id), not a generated index
    key = F.concat_ws("_", F.col("venue_id").cast("string"), "aspect", F.col("doc_id").cast("string"))
    rows = c.select("doc_id", key.alias("chunk_key"), "venue_id", "hall_name", F.col("text").alias("text_chunk"), "aspect", "text")
    kept = ("chunk_key", "venue_id", "hall_name", "text_chunk", "aspect")
    return encode.encode_pooled(rows, keep=kept).withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


def q_vector_table_roundtrip(spark, sf):
    path = shared_path(spark, "chunk-vectors")
    files.write_vectors(_chunk_vector_table(spark, sf), path)
    return files.read_vectors(spark, path)


SQL_VEC_RT = f"""WITH {CHUNKS},{CVEC_TEXT}
SELECT doc_id, CAST(venue_id AS VARCHAR) || '_' || aspect || '_' || CAST(doc_id AS VARCHAR) AS chunk_key,
       venue_id, hall_name, text AS text_chunk, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) AS vector, aspect
FROM chunks JOIN cvec USING (doc_id, aspect)"""


def q_vector_upsert(spark, sf):
    """A stored table of every embedding (version 0), and a load of every embedding shifted by n/2 ids with its vector
    negated (version 1): half updates, half inserts."""
    v = fx.vectors(spark, sf)
    n = fx.table(spark, sf, "embeddings").select(F.count(F.lit(1))).scalar()
    old = v.withColumn("version", F.lit(0))
    new = v.select((F.col("doc_id") + F.floor(n / 2)).cast("long").alias("doc_id"), "aspect",
                   F.transform("vector", lambda x: -x).alias("vector"), F.lit(1).alias("version"))
    table = upsert.KeyedTable(spark, shared_path(spark, "vector-table"), old.schema, ["doc_id"], "version").create(old)
    table.merge(new)
    return table.read().select("doc_id", "aspect", "version", "vector")


SQL_UPSERT = f"""WITH v AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS aspect, embedding AS vector FROM embeddings),
u AS (SELECT doc_id, aspect, vector, 0 AS version FROM v
      UNION ALL SELECT doc_id + ({sqlx.NVEC} // 2), aspect, list_transform(vector, lambda x: -x), 1 FROM v)
SELECT doc_id, aspect, version, vector FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS rn FROM u) WHERE rn = 1"""


# -------------------------------------------------------------- review cleaning
def _raw_reviews(spark, sf) -> DataFrame:
    """Raw review rows from conversations; user turns carry the board boilerplate."""
    c = fx.table(spark, sf, "conversations")
    return c.select(
        F.col("role").alias("name"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("user_id"),
        F.col("turn").cast("string").alias("written_days"),
        F.concat(F.lit("conv://"), F.col("conv_id").cast("string")).alias("url"),
        F.when(F.col("role") == "user", F.concat(F.lit(fixed.BOILERPLATE), F.col("text")))
        .otherwise(F.col("text")).alias("full_text"))


SQL_RAW = f"""raw AS (SELECT role AS name, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS user_id,
       CAST(turn AS VARCHAR) AS written_days, 'conv://' || CAST(conv_id AS VARCHAR) AS url,
       CASE WHEN role = 'user' THEN {sqlx.BOILER} || text ELSE text END AS full_text FROM conversations)"""


def q_clean_reviews(spark, sf):
    """Headerless CSV sink + read with names, rename, drop, literal removal, sort."""
    path = shared_path(spark, "raw-reviews")
    files.append_csv(_raw_reviews(spark, sf), path)
    raw = files.read_csv(spark, path, files.RAW_REVIEW_SCHEMA, header=False)
    out = (raw.withColumnRenamed("full_text", "review")
           .drop("written_days", "url")
           .withColumn("processed_reviews", tx.remove_literal("review", fixed.BOILERPLATE))
           .drop("review"))
    return out.orderBy("hall_name")


SQL_CLEAN = f"""WITH {SQL_RAW}
SELECT name AS hall_name, user_id, {sqlx.strip(f"replace(full_text, {sqlx.BOILER}, '')")} AS processed_reviews FROM raw"""


def q_boilerplate_audit(spark, sf):
    r = _raw_reviews(spark, sf)
    processed = tx.remove_literal("full_text", fixed.BOILERPLATE)
    return r.select("user_id", tx.contains_or_false("full_text", fixed.BOILERPLATE).alias("had_boilerplate"),
                    tx.contains_or_false(processed, fixed.BOILERPLATE).alias("remains"))


SQL_AUDIT = f"""WITH {SQL_RAW}
SELECT user_id, coalesce(contains(full_text, {sqlx.BOILER}), false) AS had_boilerplate,
       coalesce(contains({sqlx.strip(f"replace(full_text, {sqlx.BOILER}, '')")}, {sqlx.BOILER}), false) AS remains FROM raw"""


def _form_text(col_text, role, full: list[str], part: list[str]):
    return (F.when(F.col(role) == "system", F.concat_ws("\n", *[F.lit(i) for i in full], F.col(col_text)))
            .when(F.col(role) == "assistant", F.concat_ws("\n", *[F.lit(i) for i in part], F.col(col_text)))
            .otherwise(F.col(col_text)))


def q_missing_sections(spark, sf):
    """Sections filled in by rule: system turns carry all nine, assistant turns the first five."""
    c = fx.table(spark, sf, "conversations")
    t = _form_text("text", "role", fixed.REQUIRED_SECTIONS, fixed.REQUIRED_SECTIONS[:5])
    m = tx.missing_items(t, fixed.REQUIRED_SECTIONS)
    return (c.select("conv_id", "turn", m.alias("m"))
            .where(F.size("m") > 0)
            .select("conv_id", "turn", F.array_join("m", " | ").alias("missing"),
                    F.size("m").cast("long").alias("n_missing")))


def _sql_form() -> str:
    full = " || chr(10) || ".join(lit(i) for i in fixed.REQUIRED_SECTIONS)
    part = " || chr(10) || ".join(lit(i) for i in fixed.REQUIRED_SECTIONS[:5])
    return (f"CASE WHEN role = 'system' THEN {full} || chr(10) || text "
            f"WHEN role = 'assistant' THEN {part} || chr(10) || text ELSE text END")


SQL_MISSING = f"""WITH f AS (SELECT conv_id, turn, coalesce({_sql_form()}, 'None') AS t FROM conversations),
m AS (SELECT conv_id, turn, list_filter({sqlx.str_list(fixed.REQUIRED_SECTIONS)}, lambda w: NOT contains(t, w)) AS m FROM f)
SELECT conv_id, turn, array_to_string(m, ' | ') AS missing, len(m) AS n_missing FROM m WHERE len(m) > 0"""


# ------------------------------------------------------------------ tags, numbers
def _tagged(spark, sf) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    s = F.concat(F.lit("<name>"), F.col("source"), F.lit("<catering>"), F.col("lang"),
                 F.lit(" <in_guarantee>"), F.col("n_chars").cast("string"), F.lit("명<hall_vibe>  <disadvantage>"),
                 F.col("text"))
    return d.select("doc_id", s.alias("tagged"))


def q_parse_tags(spark, sf):
    t = _tagged(spark, sf)
    return t.select("doc_id", *[tx.tag_value("tagged", tag).alias(tag) for tag in fixed.INLINE_TAGS])


SQL_TAGS = f"""WITH t AS (SELECT doc_id, '<name>' || source || '<catering>' || lang || ' <in_guarantee>' || CAST(n_chars AS VARCHAR)
                          || '명<hall_vibe>  <disadvantage>' || text AS tagged FROM documents)
SELECT doc_id, {', '.join(f'{sqlx.tag_value("tagged", tag)} AS {tag}' for tag in fixed.INLINE_TAGS)} FROM t"""


def _number_texts(spark, sf) -> DataFrame:
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"),
                    F.explode(F.array(F.struct(F.lit("p_name").alias("field"), F.col("p_name").alias("text")),
                                      F.struct(F.lit("p_brand").alias("field"), F.col("p_brand").alias("text")))).alias("x")
                    ).select("id", "x.field", "x.text")


SQL_NUMTEXT = """nt AS (SELECT p_partkey AS id, 'p_name' AS field, p_name AS text FROM part
       UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part)"""


def q_digits_to_int(spark, sf):
    return _number_texts(spark, sf).select("id", "field", tx.digits_to_int("text").alias("value"))


def q_digits_or_null(spark, sf):
    return _number_texts(spark, sf).select("id", "field", tx.digits_or_null("text").alias("value"))


SQL_DIGITS = f"""WITH {SQL_NUMTEXT}
SELECT id, field, CASE WHEN {sqlx.digits('text')} = '' THEN 0 ELSE TRY_CAST({sqlx.digits('text')} AS BIGINT) END AS value FROM nt"""
SQL_DIGITS_NULL = f"""WITH {SQL_NUMTEXT}
SELECT id, field, CASE WHEN {sqlx.digits('text')} = '' THEN NULL ELSE TRY_CAST({sqlx.digits('text')} AS BIGINT) END AS value FROM nt"""


def q_apply_patches(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"),
                                           tx.digits_to_int("p_brand").alias("in_guarantee"))
    patches = spark.createDataFrame(fixed.GUARANTEE_PATCHES, PATCH_SCHEMA)
    # the patch table is a fixed literal of seven rows
    return (p.join(F.broadcast(patches), "id", "left")
            .select("id", F.coalesce("patched", "in_guarantee").alias("in_guarantee")))


SQL_PATCH = f"""WITH patch(id, v) AS (VALUES {', '.join(f'({a}, {b})' for a, b in fixed.GUARANTEE_PATCHES)})
SELECT p.p_partkey AS id, coalesce(patch.v, CASE WHEN {sqlx.digits('p.p_brand')} = '' THEN 0
       ELSE TRY_CAST({sqlx.digits('p.p_brand')} AS BIGINT) END) AS in_guarantee
FROM part p LEFT JOIN patch ON patch.id = p.p_partkey"""


# --------------------------------------------------------------------- reshaping
def _venue_wide(spark, sf) -> DataFrame:
    p = fx.table(spark, sf, "part")
    src = {"hall_vibe": F.col("p_type"), "catering": F.col("p_name"), "parking_facility": F.col("p_brand")}
    return p.select(F.col("p_partkey").alias("venue_id"), F.col("p_name").alias("hall_name"),
                    *[src.get(a, F.lit(None).cast("string")).alias(a) for a in fixed.ASPECT_COLUMNS])


def q_unpivot_aspects(spark, sf):
    return reshape.unpivot_aspects(_venue_wide(spark, sf), fixed.ASPECT_COLUMNS, ["venue_id", "hall_name"])


def _sql_unpivot_aspects() -> str:
    src = {"hall_vibe": "p_type", "catering": "p_name", "parking_facility": "p_brand"}
    parts = [f"SELECT p_partkey AS venue_id, p_name AS hall_name, {lit(a)} AS aspect, "
             f"{sqlx.strip(f'coalesce({src.get(a, chr(39) * 2)}, {chr(39) * 2})')} AS text_chunk FROM part"
             for a in fixed.ASPECT_COLUMNS]
    return " UNION ALL ".join(parts)


def q_unpivot_features(spark, sf):
    return fx.hall_features(spark, sf).select("id", "feature", "text", "score")


SQL_UNPIVOT_FEATURES = f"""WITH {sqlx.HALLS}, {sqlx.halls_wide(fx.HALL_FEATURES_13)}, {sqlx.hall_long(fx.HALL_FEATURES_13)}
SELECT id, feature, text, score FROM hf"""


def q_nested_features(spark, sf):
    nested = reshape.nest(fx.halls_wide(spark, sf), fx.HALL_FEATURES_13)
    return reshape.nested_features(nested)


SQL_NESTED_FEATURES = f"""WITH {sqlx.HALLS}, {sqlx.halls_wide(fx.HALL_FEATURES_13)}, {sqlx.hall_long(fx.HALL_FEATURES_13)},
allt AS (SELECT id, concat_ws(' ', {', '.join(fx.HALL_FEATURES_13)}) AS all_text FROM hw)
SELECT hf.id, hf.feature, hf.text, allt.all_text FROM hf JOIN allt USING (id)"""


def q_nested_filter(spark, sf):
    nested = reshape.nest(fx.halls_wide(spark, sf), fx.HALL_FEATURES_13)
    u = fx.users(spark, sf).select("user_id", "location")
    return pairs.equal_pairs(u, nested.withColumn("location", F.col("metadata.location")), ["location"]).select("user_id", "id")


SQL_NESTED_FILTER = f"""WITH {sqlx.USERS}, {sqlx.HALLS}
SELECT u.user_id, h.id FROM halls h JOIN users u ON u.location = h.location"""


# ------------------------------------------------------------ filters, counts
def q_aspect_filter(spark, sf):
    return fx.chunks(spark, sf).where(F.col("aspect") == ASPECT_PARAM).select("doc_id", "venue_id")


SQL_ASPECT = f"SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS venue_id FROM documents WHERE lang = {lit(ASPECT_PARAM)}"


def q_distinct_venues(spark, sf):
    return fx.chunks(spark, sf).select("venue_id", "hall_name").distinct()


SQL_DISTINCT = "SELECT DISTINCT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS venue_id, source AS hall_name FROM documents"


def q_location_counts(spark, sf):
    return fx.halls(spark, sf).groupBy("location").agg(F.count(F.lit(1)).alias("n"))


SQL_LOCATION = "SELECT p_brand AS location, count(*) AS n FROM part GROUP BY p_brand"


def q_venue_lookup(spark, sf):
    """Halls whose name equals a liked hall's name, in the transposed (field, value) view."""
    h = fx.halls(spark, sf)
    liked = (fx.actions(spark, sf).where(F.col("action") == "like").select(F.col("hall_id").alias("id"))
             .join(h.select("id", "name"), "id").select("name").distinct())
    m = h.join(liked, "name", "left_semi")
    return m.select("id", F.expr("stack(4, 'name', name, 'location', location, 'hall_type', hall_type, "
                                 "'price', cast(price as string)) as (field, value)"))


SQL_LOOKUP = f"""WITH {sqlx.ACTS}, {sqlx.HALLS},
liked AS (SELECT DISTINCT h.name FROM acts a JOIN halls h ON h.id = a.hall_id WHERE a.action = 'like'),
m AS (SELECT * FROM halls WHERE name IN (SELECT name FROM liked))
SELECT id, 'name' AS field, name AS value FROM m UNION ALL SELECT id, 'location', location FROM m
UNION ALL SELECT id, 'hall_type', hall_type FROM m UNION ALL SELECT id, 'price', CAST(price AS VARCHAR) FROM m"""


def q_hard_filter_2(spark, sf):
    u = fx.users(spark, sf).select("user_id", "location", "max_price")
    found = pairs.equal_pairs(u, fx.halls(spark, sf), ["location"])
    return found.where(F.col("price") <= F.col("max_price")).select("user_id", "id")


SQL_HF2 = f"""WITH {sqlx.USERS}, {sqlx.HALLS}
SELECT u.user_id, h.id FROM halls h JOIN users u ON h.location = u.location AND h.price <= u.max_price"""


def q_hard_filter_3(spark, sf):
    u = fx.users(spark, sf).select("user_id", "location", "hall_type", "max_price")
    found = pairs.equal_pairs(u, fx.halls(spark, sf), ["location", "hall_type"])
    return found.where(F.col("price") <= F.col("max_price")).select("user_id", "id")


SQL_HF3 = f"""WITH {sqlx.USERS}, {sqlx.HALLS}
SELECT u.user_id, h.id FROM halls h JOIN users u
  ON h.location = u.location AND h.hall_type = u.hall_type AND h.price <= u.max_price"""


def preferred_types(spark, sf) -> DataFrame:
    """user_id, types: hall types of the halls the user liked, plus the anchor's type."""
    h = fx.halls(spark, sf).select(F.col("id").alias("hall_id"), "hall_type")
    liked = fx.actions(spark, sf).where(F.col("action") == "like").join(h, "hall_id").select("user_id", "hall_type")
    u = fx.users(spark, sf)
    both = liked.unionByName(u.select("user_id", "hall_type"))
    return both.groupBy("user_id").agg(F.collect_set("hall_type").alias("types"))


def q_hard_filter_in(spark, sf):
    u = (fx.users(spark, sf).select("user_id", "location", "max_price")
         .join(preferred_types(spark, sf), "user_id")
         # a row per type: location and type are the keys of the join, and a hall meets one of the rows at most
         .withColumn("hall_type", F.explode("types")))
    found = pairs.equal_pairs(u, fx.halls(spark, sf), ["location", "hall_type"])
    return found.where(F.col("price") <= F.col("max_price")).select("user_id", "id")


SQL_PREF_TYPES = """ptypes AS (SELECT user_id, list(DISTINCT hall_type) AS types FROM (
    SELECT a.user_id, h.hall_type FROM acts a JOIN halls h ON h.id = a.hall_id WHERE a.action = 'like'
    UNION ALL SELECT user_id, hall_type FROM users) GROUP BY user_id)"""

SQL_HFIN = f"""WITH {sqlx.USERS}, {sqlx.HALLS}, {SQL_PREF_TYPES}
SELECT u.user_id, h.id FROM halls h JOIN users u ON h.location = u.location AND h.price <= u.max_price
JOIN ptypes p ON p.user_id = u.user_id AND list_contains(p.types, h.hall_type)"""


# --------------------------------------------------------------------- words
def q_word_freq(spark, sf, top: int = 30):
    d = fx.table(spark, sf, "documents")
    w = d.select(F.explode(tx.words(F.coalesce(F.col("text"), F.lit("nan")), WORD_PATTERN)).alias("word"))
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return _global_top(c, "n", "word", top)


SQL_WORD_FREQ = f"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, 'nan'), {lit(WORD_PATTERN)})) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT * FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 30"""


def q_word_doc_freq(spark, sf, top: int = 20):
    d = fx.noted_documents(spark, sf).where(F.col("text").isNotNull())
    stop = F.array(*[F.lit(s) for s in fixed.STOPWORDS])
    w = d.select(F.explode(F.array_except(F.array_distinct(tx.words("text", WORD_PATTERN)), stop)).alias("word"))
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))
    return _global_top(c, "n_docs", "word", top)


def _global_top(df: DataFrame, score: str, tie: str, top: int) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: each task keeps k rows), then a rank over the k kept rows."""
    from pyspark.sql import Window
    kept = df.orderBy(F.col(score).desc(), F.col(tie)).limit(top)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(tie))).cast("long"))


SQL_WORD_DOC_FREQ = f"""WITH {sqlx.NOTED}, w AS (SELECT unnest(list_distinct(regexp_extract_all(text, {lit(WORD_PATTERN)}))) AS word
                                    FROM noted WHERE text IS NOT NULL),
c AS (SELECT word, count(*) AS n_docs FROM w WHERE word NOT IN ({', '.join(lit(s) for s in fixed.STOPWORDS)}) GROUP BY word)
SELECT * FROM (SELECT word, n_docs, row_number() OVER (ORDER BY n_docs DESC, word) AS rank FROM c) WHERE rank <= 20"""


def q_hangul_words(spark, sf, top: int = 30):
    d = fx.noted_documents(spark, sf)
    w = d.select(F.explode(tx.words(F.coalesce(F.col("text"), F.lit("nan")), fixed.HANGUL_WORD)).alias("word"))
    return _global_top(w.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "n", "word", top)


SQL_HANGUL = f"""WITH {sqlx.NOTED}, w AS (SELECT unnest(regexp_extract_all(coalesce(text, 'nan'), {lit(fixed.HANGUL_WORD)})) AS word FROM noted),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT * FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 30"""


def q_extract_region(spark, sf):
    name = F.concat("name", fx.note_of(fx.PLACE_NOTES, "r", "id"))
    return fx.halls(spark, sf).select("id", tx.region_of(name).alias("region"))


def _sql_region(x: str) -> str:
    whens = " ".join(f"WHEN {sqlx.any_kw(x, words)} THEN {lit(r)}" for r, words in fixed.REGION_KEYWORDS)
    return f"CASE {whens} ELSE {lit(fixed.REGION_DEFAULT)} END"


SQL_REGION = f"""WITH n AS (SELECT p_partkey AS id, p_name || {sqlx.note_of(fx.PLACE_NOTES, 'r', 'CAST(p_partkey AS VARCHAR)')} AS name FROM part)
SELECT id, {_sql_region('name')} AS region FROM n"""


def q_keyword_flags(spark, sf):
    return fx.noted_documents(spark, sf).select("doc_id", *tx.vibe_flags("text"))


SQL_FLAGS = (f"WITH {sqlx.NOTED} SELECT doc_id, " + ", ".join(f"CAST({sqlx.any_kw('text', w)} AS INTEGER) AS {flag}"
                                            for flag, w in fixed.VIBE_FLAGS) + " FROM noted")


def q_extract_prices(spark, sf):
    d = fx.noted_documents(spark, sf)
    return d.select("doc_id", tx.first_word("text").alias("venue_name"),
                    tx.first_price("text", fixed.FOOD_PRICE_PATTERN, fixed.FOOD_PRICE_DEFAULT).alias("food_price"),
                    tx.first_price("text", fixed.HALL_PRICE_PATTERN, fixed.HALL_PRICE_DEFAULT,
                                   fixed.HALL_PRICE_UNIT).alias("hall_price"))


def _sql_price(pattern: str, default: int, unit: int = 1) -> str:
    m = f"regexp_extract(coalesce(text, ''), {lit(pattern)}, 1)"
    return (f"CASE WHEN {m} = '' THEN {default} ELSE coalesce(TRY_CAST(replace({m}, ',', '') AS BIGINT) * {unit}, {default}) END")


SQL_PRICES = f"""WITH {sqlx.NOTED} SELECT doc_id, split_part(coalesce(text, ''), ' ', 1) AS venue_name,
       {_sql_price(fixed.FOOD_PRICE_PATTERN, fixed.FOOD_PRICE_DEFAULT)} AS food_price,
       {_sql_price(fixed.HALL_PRICE_PATTERN, fixed.HALL_PRICE_DEFAULT, fixed.HALL_PRICE_UNIT)} AS hall_price FROM noted"""


def q_keyword_sentences(spark, sf):
    d = fx.noted_documents(spark, sf)
    return d.select("doc_id", tx.keyword_sentences("text", fixed.FOOD_SENTENCE_WORDS).alias("food_sentences"),
                    tx.keyword_sentences("text", fixed.PARKING_SENTENCE_WORDS).alias("parking_sentences"))


def _sql_sent(words: list[str]) -> str:
    pattern = "[^.]*(?:" + "|".join(words) + ")[^.]*\\."
    return f"array_to_string(regexp_extract_all(coalesce(text, ''), {lit(pattern)}), ' ')"


SQL_SENT = (f"WITH {sqlx.NOTED} SELECT doc_id, {_sql_sent(fixed.FOOD_SENTENCE_WORDS)} AS food_sentences, "
            f"{_sql_sent(fixed.PARKING_SENTENCE_WORDS)} AS parking_sentences FROM noted")


def q_compose_query(spark, sf):
    u = fx.users(spark, sf)
    return u.select("user_id", tx.compose_query("selected_tags", "raw_query").alias("query"))


SQL_COMPOSE = f"""WITH {sqlx.USERS}
SELECT user_id, array_to_string(selected_tags, ' ') || ' ' || coalesce(raw_query, '') AS query FROM users"""


REGISTRY = {
    "html_extract": (q_html_extract, SQL_HTML_EXTRACT),
    "html_keep_articles": (q_html_keep_articles, SQL_HTML_KEEP),
    "url_absolutise": (q_url_absolutise, SQL_URL_ABS),
    "csv_roundtrip": (q_csv_roundtrip, SQL_CSV),
    "vector_table_roundtrip": (q_vector_table_roundtrip, SQL_VEC_RT),
    "vector_upsert": (q_vector_upsert, SQL_UPSERT),
    "clean_reviews": (q_clean_reviews, SQL_CLEAN),
    "boilerplate_audit": (q_boilerplate_audit, SQL_AUDIT),
    "missing_sections": (q_missing_sections, SQL_MISSING),
    "parse_tags": (q_parse_tags, SQL_TAGS),
    "digits_to_int": (q_digits_to_int, SQL_DIGITS),
    "digits_or_null": (q_digits_or_null, SQL_DIGITS_NULL),
    "apply_patches": (q_apply_patches, SQL_PATCH),
    "unpivot_aspects": (q_unpivot_aspects, _sql_unpivot_aspects()),
    "unpivot_features": (q_unpivot_features, SQL_UNPIVOT_FEATURES),
    "nested_features": (q_nested_features, SQL_NESTED_FEATURES),
    "nested_filter": (q_nested_filter, SQL_NESTED_FILTER),
    "aspect_filter": (q_aspect_filter, SQL_ASPECT),
    "distinct_venues": (q_distinct_venues, SQL_DISTINCT),
    "location_counts": (q_location_counts, SQL_LOCATION),
    "venue_lookup": (q_venue_lookup, SQL_LOOKUP),
    "hard_filter_2": (q_hard_filter_2, SQL_HF2),
    "hard_filter_3": (q_hard_filter_3, SQL_HF3),
    "hard_filter_in": (q_hard_filter_in, SQL_HFIN),
    "word_freq": (q_word_freq, SQL_WORD_FREQ),
    "word_doc_freq": (q_word_doc_freq, SQL_WORD_DOC_FREQ),
    "hangul_words": (q_hangul_words, SQL_HANGUL),
    "extract_region": (q_extract_region, SQL_REGION),
    "keyword_flags": (q_keyword_flags, SQL_FLAGS),
    "extract_prices": (q_extract_prices, SQL_PRICES),
    "keyword_sentences": (q_keyword_sentences, SQL_SENT),
    "compose_query": (q_compose_query, SQL_COMPOSE),
}
