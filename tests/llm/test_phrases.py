import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.llm import phrases

from .conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.translate(LOWER).split("\n")]


def brute(rows, least, longest=4, inside=80):
    """(lang, phrase) -> (a, l, r, n, score) of the phrases that stay."""
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text or ""):
            n[lang] = n.get(lang, 0) + len(p)
            for k in range(1, longest + 1):
                for i in range(len(p) - k + 1):
                    g = (lang, *p[i:i + k])
                    f[g] = f.get(g, 0) + 1
    often = {g: c for g, c in f.items() if c >= least}
    most = {}
    for g, c in often.items():
        k = len(g) - 1
        for m in range(2, k):
            for s in range(1, k - m + 2):
                sub = (g[0], *g[s:s + m])
                most[sub] = max(most.get(sub, 0), c)
    out = {}
    for g, a in often.items():
        if len(g) < 3 or 100 * most.get(g, 0) >= inside * a:
            continue
        cuts = [(phrases.SCALE * a // (f[g[:1 + j]] + f[(g[0], *g[1 + j:])]), j) for j in range(1, len(g) - 1)]
        score, j = min(cuts)
        out[(g[0], " ".join(g[1:]))] = (a, f[g[:1 + j]], f[(g[0], *g[1 + j:])], n[g[0]], score)
    return out


def mined(docs, **given):
    got = phrases.collocations(docs, **given).collect()
    found = {(r.lang, " ".join(r.words)): (r.a, r.l, r.r, r.n, int(r.score)) for r in got}
    assert len(found) == len(got)
    return found


def test_against_brute_force(spark, edge_docs, edge_rows, no_docs):
    want = brute([(lang, t) for _, t, lang, _ in edge_rows], 3)
    assert len(want) > 5 and len({lang for lang, _ in want}) > 1
    assert mined(edge_docs, least=3) == want
    assert mined(no_docs, least=1) == {}


def test_small_blocks_separators_and_cases(spark, monkeypatch):
    rng = random.Random(4)
    lex = ["the", "The", "THE", "É", "é", "a b", "x-y", "(z)", "\x00", "q", "﻿"]
    sep = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", ";", ":", "!", "?", "\x0b", "\x0c", " ... "]
    rows = [(rng.choice(["en", "", None, "zz"]), "".join(rng.choice(lex) + rng.choice(sep if rng.random() < 0.4 else [" "])
                                                       for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), (None, None), ("en", ""), ("en", " \t ., "), ("only", "one two three"), ("rep", "go " * 500)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = brute(rows, 5)
    assert len(want) > 50 and ("rep", "go go go go") in want and ("rep", "go go go") not in want
    assert mined(docs, least=5) == want
    # blocks of a few texts each, several in a partition
    place = phrases.words
    monkeypatch.setattr(phrases, "BLOCK", 40)
    small = []
    monkeypatch.setattr(phrases, "words", lambda *r: small.append(place(*r)) or small[-1])
    assert mined(docs.coalesce(1), least=5) == want
    assert small[0].filter("occurrences is not null").count() > 20


def test_relation_round_trip_and_join():
    pos, gram = np.array([0, 1, 2, 4, 5, 9]), np.array([3, 1, 3, 1, 3, 1])
    p, g = phrases.unpacked(phrases.packed(pos, gram))
    assert p.tolist() == pos.tolist() and g.tolist() == gram.tolist()
    at, number, a, b, n = phrases.next_relation(pos, gram, np.array([1, 3]), np.array([70, 50]))
    assert at.tolist() == [0, 1, 4] and [(x, y, z) for x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)] == [
        (50, 70, 1), (70, 50, 2)]
    assert number.tolist() == [1, 2, 2]
    at, *_ = phrases.next_relation(pos, gram, np.array([3]), np.array([50]))     # 1 is not frequent
    assert at.tolist() == []


def test_query_ranks(spark):
    got = phrases.op11_phrases(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    want = brute([(r.lang, r.text) for r in docs], phrases.LEAST)
    for lang in {r.lang for r in got}:
        own = sorted((r for r in got if r.lang == lang), key=lambda r: r.rank)
        order = sorted(((-v[4], -v[0], p.encode()), v) for (of, p), v in want.items() if of == lang)[:phrases.TOP]
        assert [r["rank"] for r in own] == list(range(1, len(order) + 1))
        assert [((-r.score, -r.a, r.phrase.encode()), (r.a, r.l, r.r, r.n, r.score)) for r in own] == order
    assert {r.lang for r in got} == {lang for lang, _ in want}


@pytest.mark.parametrize("a", [30, 2 ** 62])
def test_scores_beyond_64_bits(spark, a):
    df = spark.range(1).select(F.lit(a).cast("long").alias("f"), F.array(F.lit(a).cast("long"), F.lit(a).cast("long")).alias("pre"),
                               F.array(F.lit(a).cast("long"), F.lit(a).cast("long")).alias("suf"))
    assert df.select(phrases._cut(2)["score"].alias("s")).first().s == phrases.SCALE // 2
