"""The stored block-max index against the plain BM25 plan: the same ranks, fewer postings read, read by another session."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from facetrank.operators import lexical, postings


def _chunks(spark, n=3000, seed=5):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(3, 30))] + [f"r{rng.randint(0, n // 15)}" for _ in range(rng.randint(1, 4))]
        rng.shuffle(words)
        rows.append((i, "ab"[i % 5 == 0], " ".join(words)))
    rows += [(n, "a", ""), (n + 1, "a", None), (n + 2, "empty", "")]
    return spark.createDataFrame(rows, "doc_id long, aspect string, text string").withColumn("text", F.coalesce("text", F.lit("")))


def _key(df):
    return sorted((r["query_id"], r["aspect"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def test_same_ranks_and_fewer_postings(spark):
    chunks = _chunks(spark)
    q = spark.createDataFrame([(0, "r1 c1"), (1, "r2 r3 c4 c4 c5"), (2, "c1 c2"), (3, "nowhere"), (4, ""), (5, "r7"), (6, "c0 c1 c2 c3 r9 r10")],
                              "query_id long, query string")
    qa = lexical.all_aspects(q, ["a", "b", "empty", "none"])
    path = postings.store(chunks)
    found = postings.search(postings.load(spark, path), q, qa, n=10)
    want = _key(lexical.bm25_topk(chunks, q, qa, n=10))
    assert _key(found.ranked) == want and len(want) > 100
    rows = lambda df: {(r["query_id"], r["aspect"]): r["s"] for r in df.groupBy("query_id", "aspect").agg(F.sum("n").alias("s")).collect()}
    read, every = rows(found.read), rows(found.every)
    assert all(read[k] <= every[k] for k in read)
    assert read[0, "a"] < 0.3 * every[0, "a"]            # the rare word decides, the common one's list is left alone
    assert sum(read.values()) < 0.6 * sum(every.values())

    other = spark.newSession()                               # the index outlives the session that wrote it
    again = postings.search(postings.load(other, path), other.createDataFrame(q.collect(), q.schema),
                            other.createDataFrame(qa.collect(), qa.schema), n=10)
    assert _key(again.ranked) == want


def test_common_terms_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(postings, "PART_ROWS", 100)
    monkeypatch.setattr(postings, "BLOCK", 16)
    chunks = _chunks(spark, 800, seed=8)
    index = postings.load(spark, postings.store(chunks))
    size = index.postings.groupBy("aspect", "term", "part").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    assert size.agg(F.max("n")).first()[0] < 200 and size.agg(F.max("m")).first()[0] <= 16
    assert index.postings.where("part > 0").count() > 0
    q = spark.createDataFrame([(0, "c1 r3"), (1, "c2 c3 c4")], "query_id long, query string")
    qa = lexical.all_aspects(q, ["a", "b"])
    assert _key(postings.search(index, q, qa, n=7).ranked) == _key(lexical.bm25_topk(chunks, q, qa, n=7))


def test_negative_idf_and_no_rows(spark):
    rows = [(i, "x", "all same words here") for i in range(6)] + [(6, "x", "all")]
    chunks = spark.createDataFrame(rows, "doc_id long, aspect string, text string")
    q = spark.createDataFrame([(0, "same here"), (1, "all")], "query_id long, query string")
    qa = lexical.all_aspects(q, ["x"])
    index = postings.load(spark, postings.store(chunks))
    assert index.aspects.first().eps < 0
    assert _key(postings.search(index, q, qa, n=3).ranked) == _key(lexical.bm25_topk(chunks, q, qa, n=3))
    empty = postings.load(spark, postings.store(chunks.filter("false")))
    assert postings.search(empty, q, qa, n=3).ranked.count() == 0


def test_a_candidate_is_scored_without_a_row_per_query(spark):
    """No join of the search makes (query, chunk) rows with the terms of the chunk."""
    chunks = _chunks(spark, 300)
    q = spark.createDataFrame([(i, "c1 c2 c3") for i in range(50)], "query_id long, query string")
    found = postings.search(postings.load(spark, postings.store(chunks)), q, lexical.all_aspects(q, ["a", "b"]), n=5)
    plan = found.ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_arrays" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert found.ranked.count() == 50 * 10


def test_sorted_rows_come_in_stretches_of_whole_keys():
    keys = [0] * 3 + [1] * 40 + [2] + [None] * 2 + list(range(3, 60))
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i:i + 4], pa.int64())}) for i in range(0, len(keys), 4)]
    out = [(t.column("k").to_pylist(), n.tolist()) for t, n in postings._runs(iter(batches), ["k"])]
    assert [x for t, _ in out for x in t] == keys and len(out) > 5
    seen = [x for t, _ in out for x in dict.fromkeys(t)]
    assert len(seen) == len(set(seen))
    assert all(n == [list(dict.fromkeys(t)).index(x) for x in t] for t, n in out)
