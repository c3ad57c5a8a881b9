"""The registered text queries take all their branches on the given tables."""

import pytest
from pyspark.sql import functions as F

from facetrank.functions import fixed
from facetrank.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, columns", [
    ("extract_region", ["region"]), ("keyword_flags", [flag for flag, _ in fixed.VIBE_FLAGS]), ("extract_prices", ["food_price", "hall_price"]),
    ("keyword_sentences", ["food_sentences", "parking_sentences"]), ("negation_factor", ["factor"]), ("rec_profile", ["weights"]),
    ("board_articles", ["author", "date"]), ("mean_pool", ["value"])])
def test_columns_vary(spark, query, columns):
    df = catalog.all_queries()[query](spark, SF)
    got = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first().asDict()
    assert all(n >= 2 for n in got.values()), got


def test_priorities_differ_and_sum_to_the_rate(spark):
    from facetrank.operators import scoring
    from facetrank.sources import fixtures as fx
    own = scoring.user_priorities(fx.users(spark, SF)).groupBy("user_id").agg(F.sum("weight").alias("t"))
    assert own.select("t").distinct().count() >= 2
    users = fx.users(spark, SF).limit(1).withColumn("priorities", F.expr("cast(map() as map<string,double>)"))
    assert {(r.feature, r.weight) for r in scoring.user_priorities(users).collect()} == set(fixed.R1_WEIGHTS)


def test_stopwords_and_hangul_words(spark):
    qs = catalog.all_queries()
    hangul = {r.word: r.n for r in qs["hangul_words"](spark, SF).collect()}
    assert any(w in hangul for w in fixed.STOPWORDS) and len(hangul) > 10
    assert not {r.word for r in qs["word_doc_freq"](spark, SF).collect()} & set(fixed.STOPWORDS)
