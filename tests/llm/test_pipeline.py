"""The pipeline against its stages worked out one by one by brute force."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetrank.llm import langid, mixing, neardup, secrets

from .conftest import SF
from .test_models import brute_classes
from .test_texts import base_spans, check_packed, window_spans


def masked(text):
    spans = sorted(base_spans(text or "") + window_spans(text or ""))
    out, at = "", 0
    for s, _, e in spans:
        if s > at or not out:
            out += text[at:s] + "[redacted]"
        at = max(at, e)
    return text if not spans else out + text[at:]


@pytest.mark.parametrize("source", ["table", "edges"])
def test_stages_and_run(spark, edge_docs, source, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else edge_docs.withColumn(
        "n_chars", F.length("text").cast("long"))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "secrets", "mix", "pack"]

    def step(name, df):
        path = str(tmp_path / name)
        stages[name](spark, df, SF).write.parquet(path)
        got = spark.read.parquet(path)
        assert name == "pack" or sorted(got.columns) == sorted(columns)
        return got

    rows = lambda df: sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", str(r.source)) for r in df.collect()))
    one = step("language", docs)
    model = langid.fit(docs, ~langid.held_out())
    found = langid.identify(docs.select("doc_id", "text", "source"), model)
    assert rows(one) == rows(found.filter("lang_pred <> 'und' and not ambiguous"))

    two = step("near_duplicates", one)
    group = brute_classes(spark, [(r.doc_id, r.text) for r in one.collect()])
    has_word = lambda x: bool(x[2].strip(" \t\n\x0b\x0c\r"))
    stay = {x for x in rows(one) if has_word(x) and group.get(x[1], x[1]) == x[1]}     # of equal rows one
    assert rows(two) == sorted([*stay, *[x for x in rows(one) if not has_word(x)]])
    assert len(rows(two)) < len(rows(one))

    three = step("secrets", two)
    assert rows(three) == sorted((a, d, masked(t), s) for a, d, t, s in rows(two))
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = step("mix", three)
    assert rows(four) == rows(three)
    order = [r.doc_id for r in mixing.mix(three).orderBy("slot", "offset").collect()]
    assert [r.doc_id for r in stages["mix"](spark, three, SF).collect()] == order

    check_packed(step("pack", four).collect(), [(r.doc_id, r.text) for r in four.collect()])


def test_packed_stream_follows_the_mixing(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, "word%d and some more " % i * (10 + i % 7), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 90 + [None] * 60)],
        "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    path = str(tmp_path / "mixed")
    stages["mix"](spark, docs, SF).repartition(5).write.parquet(path)      # read again in any order
    got = sorted(stages["pack"](spark, spark.read.parquet(path), SF).collect(), key=lambda p: (p.sequence_id, p.offset))
    mixed = mixing.mix(docs).orderBy("slot", "offset").collect()
    per, seen, places = {}, {}, {}
    for p in got:
        if p.start == 0:
            seen.setdefault(p.queue, []).append(p.doc_id)
        places.setdefault(p.queue, []).append((p.sequence_id, p.length))
    label = lambda s: "\x00null" if s is None else s
    for r in mixed:
        per.setdefault(label(r.source), []).append(r.doc_id)
    assert seen == per
    size = {}
    for r in mixed:
        size[label(r.source)] = size.get(label(r.source), 0) + r["size"]
    total = sum(math.isqrt(b) for b in size.values())
    head = min(max(s for s, _ in x) for x in places.values())              # windows before the first queue is dry
    assert head > 5
    for q, x in places.items():
        sent = sum(n for s, n in x if s < head)
        assert abs(sent - head * 2048 * math.isqrt(size[q]) / total) < 2048 / 10 + 0.01 * head * 2048


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    check_packed(got.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert corpus_pipeline.ORACLE_SQL is None and neardup.THRESHOLD >= 0.8 and secrets.WINDOW == 20


def test_empty_table(spark, no_docs):
    docs = no_docs.withColumn("n_chars", F.lit(0).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_packing_follows_the_plan_left_by_the_mixing(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word%d and some more " % i * 20, "big" if i % 9 else "mid") for i in range(400)],
                                 "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    stages["mix"](spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    placed = lambda df: sorted(map(tuple, stages["pack"](spark, df, SF).select("doc_id", "start", "sequence_id", "offset").collect()))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert "mixing" in mixed.schema["source"].metadata
    assert placed(mixed) != placed(docs)      # without the stage the packing is another
    check_packed(stages["pack"](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    note = mixed.schema["source"].metadata["mixing"]
    other = mixed.withColumn("source", F.col("source").alias("source", metadata={"mixing": note.replace('"mid"', '"none"')}))
    assert placed(other) != placed(mixed)     # and its queues are those of the plan
