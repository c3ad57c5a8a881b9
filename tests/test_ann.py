"""The inverted-file index against the exact search: recall, and how much it skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.operators import ann, dense
from facetrank.sources import fixtures as fx


def _frame(spark, m, aspects=2):
    import pandas as pd
    pdf = pd.DataFrame({"doc_id": np.arange(len(m)), "aspect": [f"a{i % aspects}" for i in range(len(m))], "vector": list(m)})
    return spark.createDataFrame(pdf, "doc_id long, aspect string, vector array<double>")


def _clustered(n, dim, clusters, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim))


def _key(df):
    return sorted((r["query_id"], r["aspect"], r["rank"], r["doc_id"], round(r["sim"], 9)) for r in df.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    corpus, qv = fx.vectors(spark, sf), fx.query_vectors(spark, sf)
    got = {(r.query_id, r.aspect, r.doc_id) for r in ann.dense_topk_ivf(corpus, qv).collect()}
    want = {(r.query_id, r.aspect, r.doc_id) for r in dense.dense_topk(corpus, qv).collect()}
    assert len(got & want) / len(want) >= 0.9
    assert got == want                                   # a full cover loses nothing


def test_skips_most_of_clustered_vectors(spark):
    shares = {}
    for n in (4_000, 16_000):
        m = _clustered(n, 24, n // 100, 0.08)
        corpus = _frame(spark, m)
        qv = corpus.where("doc_id % 200 = 0").select(F.col("doc_id").alias("query_id"), "vector")
        found = ann.search(ann.build_index(corpus), qv, n=10)
        want = dense.dense_topk(corpus, qv, n=10)
        assert _key(found.ranked) == _key(want)
        compared = found.probes.agg(F.sum("n")).first()[0]
        shares[n] = compared / (n * qv.count())
    assert shares[16_000] < 0.2 and shares[16_000] < shares[4_000]


def test_cover_trades_recall_for_rows(spark):
    corpus = _frame(spark, _clustered(6_000, 24, 60, 0.3, seed=2))
    qv = corpus.where("doc_id % 150 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    want = {(r.query_id, r.aspect, r.doc_id) for r in dense.dense_topk(corpus, qv, n=10).collect()}
    rows = {}
    for cover in (1.0, 0.6):
        found = ann.search(ann.build_index(corpus, cover), qv, n=10)
        got = {(r.query_id, r.aspect, r.doc_id) for r in found.ranked.collect()}
        assert len(got & want) / len(want) >= 0.9
        rows[cover] = found.probes.agg(F.sum("n")).first()[0]
    assert rows[0.6] < rows[1.0]


def test_ties_small_groups_and_empty_tables(spark):
    rows = [(i, "x", [1.0, 0.0]) for i in range(300)] + [(1000 + i, "y", [0.0, 1.0]) for i in range(3)] + [(2000, "z", None)]
    corpus = spark.createDataFrame(rows, "doc_id long, aspect string, vector array<float>")
    qv = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "query_id long, vector array<float>")
    got = ann.dense_topk_ivf(corpus, qv, n=5).collect()
    for q in (1, 2):
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q and r.aspect == "x"), key=lambda r: r.rank)] == [0, 1, 2, 3, 4]
        assert len([r for r in got if r.query_id == q and r.aspect == "y"]) == 3
    assert {r.aspect for r in got} == {"x", "y"}
    asked = spark.createDataFrame([(1, "y")], "query_id long, aspect string")
    assert {(r.query_id, r.aspect) for r in ann.dense_topk_ivf(corpus, qv, asked, n=5).collect()} == {(1, "y")}
    assert ann.dense_topk_ivf(corpus.filter("false"), qv).count() == 0
    assert ann.dense_topk_ivf(corpus, qv.filter("false")).count() == 0
