"""Hand-computed retrieval, fusion, roll-up and metric values (FIXTURES.md section 3)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.functions.vectors import cosine
from facetrank.operators import fusion, lexical, metrics, rollup
from facetrank.operators.dense import dense_topk

SF = "/root/testdata/sf0.001"


def test_rrf_values(spark):
    rows = [(1, 1), (2, 5), (1, None), (28, 28), (50, 50), (50, None)]
    df = spark.createDataFrame(rows, "d_rank int, s_rank int").select(fusion.rrf_score().alias("r"))
    got = [round(r["r"], 8) for r in df.collect()]
    assert got == [0.03278689, 0.03151365, 0.02264344, 0.02272727, 0.01818182, 0.01534091]
    # 28th in both lists beats first in one list only
    assert got[3] > got[2]


def test_rrf_symmetric(spark):
    df = spark.createDataFrame([(3, 9), (9, 3), (None, 4), (4, None)], "d_rank int, s_rank int")
    v = [r["r"] for r in df.select(fusion.rrf_score().alias("r")).collect()]
    assert v[0] == v[1] and v[2] == v[3]


CHUNKS = [(0, 1, "v1", "x", "a b c"), (1, 1, "v1", "x", "a a d"), (2, 2, "v2", "x", "e f"),
          (3, 2, "v2", "x", ""), (4, 3, "v3", "x", "a g")]
SCHEMA = "doc_id long, venue_id long, hall_name string, aspect string, text string"


def _bm25(spark, query):
    ch = spark.createDataFrame(CHUNKS, SCHEMA)
    q = spark.createDataFrame([(0, query)], "query_id long, query string")
    qa = lexical.all_aspects(q, ["x"])
    return {r["doc_id"]: (r["score"], r["rank"]) for r in lexical.bm25_topk(ch, q, qa).collect()}


def test_bm25_hand_example(spark):
    ch = spark.createDataFrame(CHUNKS, SCHEMA)
    terms, aspects = lexical.term_stats(ch)
    a = aspects.collect()[0]
    assert a["n_docs"] == 5 and a["avgdl"] == pytest.approx(2.0)
    assert a["mean_idf"] == pytest.approx(0.8936, abs=1e-4)
    idf = {r["term"]: r["idf"] for r in terms.collect()}
    assert idf["a"] == pytest.approx(0.2234, abs=1e-4)
    assert idf["b"] == pytest.approx(1.098612, abs=1e-6)
    s = _bm25(spark, "a e")
    assert [round(s[i][0], 6) for i in range(5)] == pytest.approx([0.182367, 0.274954, 1.098612, 0.0, 0.2234], abs=1e-4)
    assert len(s) == 5  # the empty chunk is still ranked
    s2 = _bm25(spark, "a e a")  # repeated query terms count repeatedly
    assert [round(s2[i][0], 4) for i in range(5)] == pytest.approx([0.3647, 0.5499, 1.0986, 0.0, 0.4468], abs=1e-4)


def test_bm25_no_matching_term_pads_with_zeros(spark):
    s = _bm25(spark, "zzz")
    assert sorted(s) == [0, 1, 2, 3, 4]
    assert all(v[0] == 0.0 for v in s.values())
    assert [s[i][1] for i in range(5)] == [1, 2, 3, 4, 5]  # ties by id


def test_bm25_padding_length_and_empty_aspect(spark):
    rows = [(i, i, "v", "x", f"w{i % 7} common") for i in range(80)]
    ch = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(0, "w3"), (1, "nothing")], "query_id long, query string")
    out = lexical.bm25_topk(ch, q, lexical.all_aspects(q, ["x", "empty"]), n=50)
    counts = {(r["query_id"], r["aspect"]): r["c"] for r in out.groupBy("query_id", "aspect").agg(F.count("*").alias("c")).collect()}
    assert counts == {(0, "x"): 50, (1, "x"): 50}
    top = out.where("query_id = 0").orderBy("rank").limit(12).collect()
    assert all(r["score"] > 0 for r in top[:11]) and {r["doc_id"] % 7 for r in top[:11]} == {3}
    assert top[11]["score"] == 0.0 and top[11]["doc_id"] == 0


def test_dense_topk_exact(spark):
    corpus = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "x", [0.0, 1.0]), (2, "x", [1.0, 1.0]),
                                    (3, "y", [1.0, 0.0])], "doc_id long, aspect string, vector array<float>")
    qv = spark.createDataFrame([(7, [1.0, 0.2])], "query_id long, vector array<float>")
    got = [(r["aspect"], r["doc_id"], r["rank"]) for r in dense_topk(corpus, qv, n=2).orderBy("aspect", "rank").collect()]
    assert got == [("x", 0, 1), ("x", 2, 2), ("y", 3, 1)]


def _rollup(spark, rows, n):
    rr = spark.createDataFrame([(0, h, a, s) for h, a, s in rows], "query_id long, hall_id long, aspect string, cross_score double")
    na = spark.createDataFrame([(0, n)], "query_id long, n_aspects int")
    return {r["hall_id"]: r["total_score"] for r in rollup.soft_weight_rollup(rr, na).collect()}


def test_rollup_golden_rows(spark):
    # rows of the reviewed run logs (two aspects asked, N = 2)
    got = _rollup(spark, [(1168, "hall_vibe", 0.8063), (1168, "catering", 0.0001), (1126, "hall_vibe", 0.9990),
                          (1008, "hall_vibe", 0.9254), (1008, "hall_vibe", 0.8655), (1008, "hall_vibe", 0.8127),
                          (1008, "hall_vibe", 0.7104), (1008, "hall_vibe", 0.3335), (1008, "catering", 0.1010),
                          (1008, "hall_vibe", 0.0030), (1008, "hall_vibe", 0.0010)], 2)
    assert got[1168] == pytest.approx(1.6128, abs=2e-4)
    assert got[1126] == pytest.approx(1.4985, abs=2e-4)
    assert got[1008] == pytest.approx(2.0528, abs=2e-4)
    single = _rollup(spark, [(1126, "hall_vibe", 0.5991)], 2)
    assert single[1126] == pytest.approx(0.8987, abs=2e-4)


def test_rollup_independent_of_row_order(spark):
    rows = [(1, "a", 0.3), (1, "b", 0.2), (2, "a", 0.9), (1, "a", 0.5)]
    assert _rollup(spark, rows, 3) == _rollup(spark, list(reversed(rows)), 3)


def test_step_weight(spark):
    rr = spark.createDataFrame([(0, 1, "a", 0.4), (0, 2, "a", 0.4), (0, 2, "b", 0.2)],
                               "query_id long, hall_id long, aspect string, cross_score double")
    got = {r["hall_id"]: r["total_score"] for r in rollup.step_weight_rollup(rr).collect()}
    assert got[1] == pytest.approx(0.2) and got[2] == pytest.approx(0.9)


def test_metrics_hand_example(spark):
    q = spark.createDataFrame([(0,), (1,)], "query_id long")
    ranking = spark.createDataFrame([(0, h, i + 1) for i, h in enumerate([7, 3, 9, 1])], "query_id long, hall_id long, rank int")
    gold = spark.createDataFrame([(0, 3), (0, 1), (0, 8)], "query_id long, hall_id long")
    m = {r["query_id"]: r for r in metrics.ranking_metrics(q, gold, ranking).collect()}
    assert m[0]["mrr"] == pytest.approx(0.25)
    assert m[0]["hit_rate"] == 1.0
    assert m[0]["ndcg"] == pytest.approx(0.498189, abs=1e-6)
    # empty gold gives zeros
    assert (m[1]["mrr"], m[1]["hit_rate"], m[1]["ndcg"]) == (0.0, 0.0, 0.0)
    rec = {r["query_id"]: r["recall"] for r in metrics.recall(q, gold, ranking).collect()}
    assert rec[0] == pytest.approx(2 / 3) and rec[1] == 0.0
    for r in m.values():
        assert 0 <= r["ndcg"] <= 1 and 0 <= r["mrr"] <= 1 and not math.isnan(r["ndcg"])


def test_gold_short_passages(spark):
    from facetrank.operators.gold import substring_gold
    ch = spark.createDataFrame([(0, 1, "v1", "x", "one two three four five six"), (1, 2, "v2", "x", "xx abcd yy"),
                                (2, 3, "v3", "x", "alpha beta gamma")], SCHEMA)
    q = spark.createDataFrame([(0, "two three four five"), (1, "bc"), (2, "beta gamma"), (3, "one two three four five"),
                               (4, "zz")], "query_id long, query string")
    got = sorted((r["query_id"], r["hall_id"]) for r in substring_gold(ch, q).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 1)]


def test_report_sink_roundtrip(spark):
    from facetrank.operators.rollup import write_report
    from facetrank.session import shared_path
    name = '홀, "A"' + "\n" + "B"
    df = spark.createDataFrame([(1, 7, name, 1.6128)], "rank int, hall_id long, hall_name string, total_score double")
    path = shared_path(spark, "report-test")
    write_report(df, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()
    assert back[0]["hall_name"] == name and back[0]["total_score"] == "1.6128"


def test_two_stage_no_intent_and_no_candidates(spark):
    from facetrank.plans import two_stage as ts
    chunks = spark.createDataFrame([(0, 1, "v1", "x", "red wine cellar"), (1, 2, "v2", "x", "red garden hall"),
                                    (2, 2, "v2", "y", "quiet parking lot")], SCHEMA)
    cv = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "x", [0.0, 1.0]), (2, "y", [1.0, 1.0])],
                               "doc_id long, aspect string, vector array<float>")
    q = spark.createDataFrame([(0, "red garden hall"), (1, "zzz qqq")], "query_id long, query string")
    qv = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "query_id long, vector array<float>")
    venues = spark.createDataFrame([(1, "v1"), (2, "v2")], "venue_id long, hall_name string")
    inp = ts.Inputs(chunks, cv, q, qv, venues, ["x", "y"])
    r = ts.run(inp)
    counts = {row["query_id"]: row["n_aspects"] for row in r.counts.collect()}
    assert counts == {0: 1, 1: 1}  # query 1 asks for no aspect: N = 1 but no candidates
    assert {row["query_id"] for row in r.candidates.collect()} == {0}
    top = r.top.where("query_id = 0").orderBy("rank").collect()
    assert top[0]["hall_id"] == 2 and top[0]["total_score"] == pytest.approx(2.0)
    assert r.top.where("query_id = 1").count() == 0
    rec, met = ts.evaluate(inp, r)
    m = {row["query_id"]: row for row in met.collect()}
    assert m[0]["n_gold"] == 1 and m[0]["mrr"] == 1.0 and m[0]["ndcg"] == 1.0
    assert (m[1]["n_gold"], m[1]["mrr"], m[1]["hit_rate"]) == (0, 0.0, 0.0)


def test_lsh_returns_exact_cosines_in_rank_order(spark):
    import math
    import random

    import numpy as np

    from facetrank.operators.dense import dense_topk_lsh
    rnd = random.Random(7)
    docs = [(i, "ab"[i % 2], [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(40)]
    qs = [(q, [rnd.uniform(-1, 1) for _ in range(8)]) for q in range(3)]
    corpus = spark.createDataFrame(docs, "doc_id long, aspect string, vector array<float>")
    qv = spark.createDataFrame(qs, "query_id long, vector array<float>")
    rows = dense_topk_lsh(corpus, qv, n=5, tables=3, bits=2, dim=8).collect()
    assert rows
    vec = {i: v for i, _, v in docs}
    qvec = dict(qs)

    def cos(a, b):
        a = np.asarray(a, dtype=np.float32).astype(np.float64)  # stored as float, widened to double
        b = np.asarray(b, dtype=np.float32).astype(np.float64)
        return float(a @ b / math.sqrt((a @ a) * (b @ b)))
    by_group = {}
    for r in rows:
        assert r["sim"] == pytest.approx(cos(qvec[r["query_id"]], vec[r["doc_id"]]), abs=1e-6)
        by_group.setdefault((r["query_id"], r["aspect"]), []).append((r["rank"], r["sim"]))
    for g in by_group.values():
        sims = [s for _, s in sorted(g)]
        assert sims == sorted(sims, reverse=True) and len(g) <= 5


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_lsh_recall(spark, sf):
    from facetrank.operators import dense
    from facetrank.sources import fixtures as fx
    corpus, qv = fx.vectors(spark, sf), fx.query_vectors(spark, sf)
    top = lambda df: {(r["query_id"], r["aspect"], r["doc_id"]) for r in df.collect()}
    exact, found = top(dense.dense_topk(corpus, qv)), top(dense.dense_topk_lsh(corpus, qv))
    assert len(exact & found) / len(exact) >= 0.9


def test_lsh_prunes_vectors_that_cluster(spark):
    import numpy as np

    from facetrank.operators import dense
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 64))[rng.integers(0, 40, 2000)] + 0.05 * rng.standard_normal((2000, 64))
    corpus = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(m)], "doc_id long, aspect string, vector array<double>")
    qv = corpus.where("doc_id % 40 = 0").selectExpr("doc_id as query_id", "vector")
    pairs = dense.lsh_pairs(corpus, qv, tables=8, bits=6)
    assert pairs.count() < 0.3 * 2000 * 50
    near = dense.dense_topk(corpus, qv, n=20).where("sim > 0.9").select("query_id", "doc_id")
    hit = near.join(pairs, ["query_id", "doc_id"], "left_semi").count()
    assert hit / near.count() >= 0.9


def test_dense_blocks_agree(spark):
    from facetrank.operators import dense
    from facetrank.sources import fixtures as fx
    corpus, qv = fx.vectors(spark, SF), fx.query_vectors(spark, SF)
    one = dense.rank_within(dense.dense_candidates(corpus, qv, corpus_blocks=1), ["query_id", "aspect"], "sim", "doc_id", 50)
    many = dense.rank_within(dense.dense_candidates(corpus, qv, corpus_blocks=5, query_blocks=3),
                             ["query_id", "aspect"], "sim", "doc_id", 50)
    key = lambda df: sorted((r["query_id"], r["aspect"], r["rank"], r["doc_id"], round(r["sim"], 9)) for r in df.collect())
    assert key(one) == key(many)
    assert dense.dense_candidates(corpus, qv, corpus_blocks=1, n=3).count() == 3 * qv.count() * corpus.select("aspect").distinct().count()


def test_gold_with_every_kind_of_passage(spark):
    from facetrank.operators import gold
    texts = [(0, 1, "alpha beta gamma delta epsilon zeta"), (1, 2, "x beta gamma y"), (2, 3, "prealpha, b"), (3, 4, ""), (4, 4, "éa")]
    passages = ["alpha beta gamma delta epsilon", "beta gamma delta", "pha, b", "a", "é", "ph", "beta", "", "nowhere", "beta gamma"]
    ch = spark.createDataFrame(texts, "doc_id long, venue_id long, text string")
    q = spark.createDataFrame(list(enumerate(passages)), "query_id long, query string")
    got = {(r["query_id"], r["hall_id"]) for r in gold.substring_gold(ch, q).collect()}
    assert got == {(i, v) for i, p in enumerate(passages) for _, v, t in texts if p in t}


def test_csv_starts_with_a_byte_order_mark(spark, tmp_path):
    from facetrank.operators.rollup import write_report
    df = spark.createDataFrame([(1, "가, \"b\"\nc")], "rank long, hall_name string").coalesce(1)
    write_report(df, str(tmp_path / "r"))
    part = next((tmp_path / "r").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfrank,hall_name")


def test_checkpointed_index_equals_persisted(spark):
    ch = spark.createDataFrame(CHUNKS, SCHEMA)
    q = spark.createDataFrame([(0, "a e"), (1, "g c a")], "query_id long, query string")
    qa = lexical.all_aspects(q, ["x"])
    a = lexical.bm25_topk(ch, q, qa, index=lexical.build_index(ch, materialize="checkpoint"))
    b = lexical.bm25_topk(ch, q, qa, index=lexical.build_index(ch, materialize="persist"))
    key = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in df.collect())
    assert key(a) == key(b) and len(key(a)) == 10


def test_gold_in_several_groups_of_passages(spark):
    from facetrank.operators import gold
    texts = [(i, i % 7, f"start {i} middle word{i % 13} the end é{i}") for i in range(60)] + [(60, None, "word1 x"), (61, 3, None)]
    passages = ["word1", "word1 the", "é5", "", "middle", "nowhere", "word1", None] + [f"start {i}" for i in range(0, 60, 9)]
    ch = spark.createDataFrame(texts, "doc_id long, venue_id long, text string")
    q = spark.createDataFrame(list(enumerate(passages)), "query_id long, query string")
    want = {(i, v) for i, p in enumerate(passages) if p is not None for _, v, t in texts if t is not None and p in t}
    for size in (1 << 20, 200):                              # one group, and a group for a passage or two
        got = [(r["query_id"], r["hall_id"]) for r in gold.substring_gold(ch, q, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert gold.substring_gold(ch, q.filter("false")).count() == 0
    assert gold.substring_gold(ch.filter("false"), q).count() == 0


def test_pooling_under_a_mask():
    import numpy as np

    from facetrank.operators import encode
    v = np.array([[1.0, 0.0], [0.0, 3.0], [5.0, 5.0]])
    assert encode.pooled(v, np.array([1.0, 1.0, 0.0])).tolist() == pytest.approx([1 / math.sqrt(10), 3 / math.sqrt(10)])
    assert encode.pooled(v, np.zeros(3)).tolist() == [0.0, 0.0]
    vectors, mask = encode.HashedTokens()(["a", "=", "b!", "--"])
    assert mask.tolist() == [1, 0, 1, 0] and (vectors.sum(1) == 1).all()


def test_every_chunk_gets_a_vector_and_tokens_are_cut(spark):
    import numpy as np

    from facetrank.operators import encode
    texts = ["a b", "", None, " = - ", " ".join(["a"] * 512 + ["zebra"] * 100), " é b"]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, aspect string, text string")
    got = {r.doc_id: np.array(r.vector) for r in encode.encode_pooled(df, keep=("aspect",)).collect()}
    bucket = encode.HashedTokens().bucket
    assert len(got) == 6 and all(len(v) == encode.DIMS for v in got.values())
    assert not got[1].any() and not got[2].any() and not got[3].any()
    assert got[4][bucket("a")] == pytest.approx(1.0)         # nothing beyond the 512th token
    assert got[0][bucket("b")] == pytest.approx(1 / math.sqrt(2))

    class Lengths:
        def __call__(self, tokens):
            return np.array([[len(t), 1.0] for t in tokens]).reshape(-1, 2), np.ones(len(tokens))
    got = {r.doc_id: r.vector for r in encode.encode_pooled(df, encoder_factory=Lengths).collect()}
    assert got[0] == pytest.approx([1 / math.sqrt(2), 1 / math.sqrt(2)]) and got[1] == [0.0, 0.0]


def test_bm25_makes_no_row_per_query_and_chunk(spark):
    """Repeated ids, empty texts and terms of weight 0 (half the chunks have them) rank as by the definition."""
    rows = [(i % 40, "x", " ".join(["half"] * (i % 2) + [f"w{i % 7}"] * (i % 4))) for i in range(50)] + [(99, "x", "")]
    nulls = [(i, None, "half w1") for i in range(20)]        # belong to no aspect that can be asked for
    chunks = spark.createDataFrame(rows + nulls, "doc_id long, aspect string, text string")
    q = spark.createDataFrame([(0, "half w1 w1"), (1, "w3 none"), (2, "half")], "query_id long, query string")
    qa = lexical.all_aspects(q, ["x"])
    index = lexical.build_index(chunks)
    terms, asp = {r.term: r.idf for r in index.terms.where("aspect = 'x'").collect()}, index.aspects.where("aspect = 'x'").first()
    want = {}
    for query in q.collect():
        score = {}
        for r in index.postings.where("aspect = 'x' and term is not null").collect():
            if r.term in query["query"].split():
                norm = 1.5 * (0.25 + 0.75 * r.dl / asp.avgdl)
                score[r.doc_id] = score.get(r.doc_id, 0) + query["query"].split().count(r.term) * terms[r.term] * r.tf * 2.5 / (r.tf + norm)
        for d in sorted(d for d, *_ in rows)[:10]:
            score.setdefault(d, 0.0)
        want[query["query_id"]] = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    found = lexical.bm25_topk(chunks, q, qa, n=10)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for k, v in want.items():
        assert [d for d, _ in got[k]] == [d for d, _ in v]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[k], v, strict=True))


def test_lsh_in_blocks_is_lsh_over_pairs(spark):
    from facetrank.operators import dense
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=64).tolist() for _ in range(60)]
    vectors[5] = None
    vectors[6] = [*vectors[6][:-1], None]
    rows = [(i % 55, None if i % 11 == 0 else "ab"[i % 2], vectors[i]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "doc_id long, aspect string, vector array<double>")
    qv = spark.createDataFrame([(i, vectors[i]) for i in range(20)] + [(3, vectors[30])], "query_id long, vector array<double>")
    hits = (dense.lsh_pairs(corpus, qv, 3, 4).join(qv.withColumnRenamed("vector", "qv"), "query_id").join(corpus, "doc_id")
            .select("query_id", "aspect", "doc_id", cosine("qv", "vector").alias("sim")))
    key = lambda df: sorted((r.query_id, str(r.aspect), r["rank"], r.doc_id, round(-9 if r.sim is None else r.sim, 6)) for r in df.collect())
    found = dense.dense_topk_lsh(corpus, qv, 9, 3, 4)
    assert " Join " not in found._jdf.queryExecution().optimizedPlan().toString()
    want = key(dense.rank_within(hits, ["query_id", "aspect"], "sim", "doc_id", 9))
    got = key(found)
    assert [x[:3] for x in got] == [x[:3] for x in want] and sorted(x[:2] + x[3:] for x in got) == sorted(x[:2] + x[3:] for x in want)
