import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.llm import langid, neardup, neighbours, scoring

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -------------------------------------------------------------- language id
def test_langid_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op7_langid(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.ambiguous for r in got) < 0.01 * len(got)


def test_langid_edges(spark, edge_docs, no_docs):
    model = langid.fit(edge_docs, F.lit(True))
    got = langid.identify(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters)
        assert r.lang_pred in ("en", "fr", "und") and r.slot == 7
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in langid.identify(edge_docs, empty).collect()} == {"und"}
    one = langid.fit(edge_docs.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(edge_docs, one).collect()} == {"en", "und"}


def test_langid_learns_every_label(spark):
    rng = np.random.default_rng(2)
    lex = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)] for _ in range(90)]
    rows = [(100 * n + i, " ".join(rng.choice(lex[n], 30)), f"l{n:02}") for n in range(90) for i in range(8 if n < 64 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    train = F.col("doc_id") % 100 != 0
    model = langid.fit(docs, train)
    assert model.languages == [f"l{n:02}" for n in range(90)]
    got = langid.identify(docs.filter(~train), model).collect()
    assert len(got) == 90 and sum(r.lang_pred == r.lang for r in got) >= 86
    assert langid.fit(docs, train, sample=100).languages == model.languages       # one text each
    with pytest.raises(ValueError, match="90 labels"):
        langid.fit(docs, train, sample=89)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_are_distinct(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    if n > 2:
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert gap >= (2 if n == 3 else 4)


# --------------------------------------------------------------- neighbours
def brute(vectors, queries, k=10):
    ids = np.array([i for i, _ in vectors])
    m = np.array([v for _, v in vectors], dtype=float)
    out = {}
    for qid, q in queries:
        d = np.sqrt(((m - np.array(q, dtype=float)) ** 2).sum(1))
        keep = ids != qid
        by = np.lexsort((ids[keep], d[keep]))[:k]
        out[qid] = list(zip(ids[keep][by].tolist(), d[keep][by].tolist(), strict=True))
    return out


def test_neighbour_recall(spark):
    got = neighbours.op8_nearest(spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    vec = dict(rows)
    for q, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)
        for r in rs:
            assert r.score == pytest.approx(math.dist(vec[q], vec[r.vec_id]), abs=1e-12)
        hits += len({r.vec_id for r in rs} & {i for i, _ in want[q]})
    assert hits / sum(len(x) for x in want.values()) >= 0.9


def test_neighbours_with_cells_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).round(3).tolist()) for i in range(1500)]
    rows += [(2000 + i, [0.5] * 16) for i in range(800)]           # one very common vector
    rows += [(2900, [0.5] * 16)]                                   # a query among its copies
    bad = [(3000, None), (3100, [0.0] * 16), (3200, [1.0] * 15 + [float("nan")]), (3300, [1.0] * 15 + [None]),
           (3400, [1.0] * 15 + [float("inf")]), (3500, []), (3600, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, cell_rows=128).collect()
    queries = [r for r in rows if r[0] % 100 == 0]
    want = brute(rows, queries)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)                                    # the lone vector of length 2 finds nothing
    hits = sum(len({v for _, v, _ in by[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    assert [v for _, v, _ in sorted(by[2900])] == [v for v, _ in want[2900]]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect()] == [(1, 1), (1, 2)]
    assert neighbours.nearest(few.filter("false"), F.lit(True)).count() == 0


def test_chi_square():
    assert neighbours.chi2_cdf(np.array([13.3616]), 8)[0] == pytest.approx(0.9, abs=1e-4)
    assert neighbours.chi2_bound(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


# ------------------------------------------------------------------ scoring
def ppm(train, texts, order=scoring.ORDER):
    """log10 probabilities by walking the contexts of every byte."""
    counts = {}
    pad = bytes([scoring.START]) * order
    code = lambda t: pad + t.encode() + bytes([scoring.END])
    for t in train:
        b = code(t)
        for i in range(order, len(b)):
            for o in range(order + 1):
                c = counts.setdefault(b[i - o:i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    out = []
    for t in texts:
        b, score = code(t), 0.0
        for i in range(order, len(b)):
            gone = set()
            for o in range(order, -1, -1):
                seen = {s: n for s, n in counts.get(b[i - o:i], {}).items() if s not in gone}
                if not seen:
                    continue
                total, distinct = sum(seen.values()), len(seen)
                if b[i] in seen:
                    score += math.log10(seen[b[i]] / (total + distinct))
                    break
                score += math.log10(distinct / (total + distinct))
                gone |= set(seen)
            else:
                score -= math.log10(256 - len(gone))
        out.append(score)
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def check_scores(got, rows):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    train = [lower(t) for d, t in rows if not held[d]]
    counts = {}
    for t in train:
        for w in [*WORD.findall(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    want = dict(zip(texts, ppm(train, [lower(t) for t in texts.values()]), strict=True))
    assert len(got) == len(rows)
    for r in got:
        w = [*WORD.findall(lower(texts[r.doc_id])), None]
        c = [counts.get(x, 0) for x in w]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9), r.doc_id


def test_scores_match_brute_force(spark, edge_docs, edge_rows):
    rows = [(d, t) for d, t, *_ in edge_rows if d != 208]
    check_scores(scoring.scored(edge_docs.filter("doc_id <> 208"), scoring.held_out()).collect(), rows)


def test_score_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_scores(scoring.op9_score(spark, SF).collect(), rows)


def test_scores_without_training(spark, edge_docs, no_docs):
    got = scoring.scored(edge_docs.filter("doc_id < 3"), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert all(r.score < 0 for r in got)
    assert scoring.scored(no_docs, scoring.held_out()).count() == 0


# ------------------------------------------------------------------ near duplicates
def brute_classes(spark, rows):
    """Components of all pairs of different word sequences with weighted Jaccard >= 0.8."""
    words = neardup.Words()
    seqs = {}
    for d, t in rows:
        w = tuple(WORD.findall(t or ""))
        if w and d is not None:
            seqs.setdefault(w, set()).add(d)
    df = np.zeros(neardup.SLOTS)
    docs = [words(t or "") for _, t in rows]
    for h in docs:
        df[np.unique((h & np.uint64(neardup.SLOTS - 1)).astype(int))] += 1
    idf = np.log1p(sum(len(h) > 0 for h in docs) / np.maximum(1, df))
    reps = sorted((min(ids), neardup.shingles(words(" ".join(w)), idf)) for w, ids in seqs.items())
    parent = {d: min(ids) for ids in seqs.values() for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, sa) in enumerate(reps):
        for b, sb in reps[i + 1:]:
            if len(np.intersect1d(sa[0][:20000], sb[0][:20000])) and neardup.similarity(sa, sb) >= neardup.THRESHOLD:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def test_classes_match_brute_force(spark, edge_docs, edge_rows):
    want = brute_classes(spark, [(d, t) for d, t, *_ in edge_rows])
    got = {r.id: r["class"] for r in neardup.classes(edge_docs).collect()}
    assert got == want
    assert all(got[100 + j] == 1 for j in range(6) if len(edge_rows[1][1].split()) > 100) and got[200] == got[201] == 2


def plain_similarity(a, b, idf):
    """Weighted Jaccard of TF-IDF shingles, without hashes or grids."""
    def bag(words):
        k = min(neardup.SHINGLE, len(words))
        out = {}
        for i in range(len(words) - k + 1):
            g = tuple(words[i:i + k])
            out[g] = out.get(g, 0) + sum(idf[w] for w in g) / k
        return out
    a, b = bag(a), bag(b)
    return sum(min(a[g], b[g]) for g in a if g in b) / sum(max(a.get(g, 0), b.get(g, 0)) for g in a.keys() | b.keys())


def test_similarity_is_plain_weighted_jaccard(edge_rows):
    rng = np.random.default_rng(6)
    lex = [f"w{i}" for i in range(60)]
    texts = [list(rng.choice(lex, n)) for n in (40, 200, 3, 900)]
    texts += [[*texts[1][:150], *rng.choice(lex, 40)], [*texts[3], *["a", "b", "c", "d", "e"] * 700], ["a", "b", "c", "d", "e"] * 900]
    df = {w: sum(w in t for t in texts) for t in texts for w in t}
    idf = {w: math.log(1 + len(texts) / n) for w, n in df.items()}
    words, slots = neardup.Words(), np.zeros(neardup.SLOTS)
    for w, v in idf.items():
        slots[int(words(w)[0]) & (neardup.SLOTS - 1)] = v
    bags = [neardup.shingles(words(" ".join(t)), slots) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert neardup.similarity(bags[i], bags[j]) == pytest.approx(plain_similarity(a, b, idf), abs=1e-9)


def test_counts_of_repeated_words_are_not_clipped(spark):
    """Five words 2,000 and 20,000 times: weighted Jaccard 0.1, two classes."""
    rows = [(1, "a b c d e " * 2_000), (2, "a b c d e " * 20_000), (3, "a b c d e " * 19_000), (4, "x y z " * 10)]
    got = {r.id: r["class"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


def test_one_row_of_a_class_is_kept(spark):
    a, b = "one two three four five six seven eight", "one two three four five six seven eight nine"
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, a, 5), (1, a, 5), (1, a, 5), (2, a, 6), (None, a, 7), (None, a, 7), (3, long, 1), (3, long + " end", 2), (4, long + " z", 3),
            (None, b, 8), (None, b, 8), (9, None, 1), (9, None, 1), (None, "", 1), (None, " \t", 1), (5, " " + a + "  ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(3)
    # the ninth word is rare and weighs more than the others: a and b are below 0.8
    want = [(1, a, 5), (3, long, 1), (None, b, 8), (9, None, 1), (9, None, 1), (None, "", 1), (None, " \t", 1)]
    got = [tuple(r) for r in neardup.kept(docs).collect()]
    order = lambda x: sorted(x, key=str)
    got = [x if x[1] != long + " end" else (3, long, 1) for x in got]     # two texts of doc_id 3: either may stand
    assert order(got) == order(want)


def test_neardup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_classes(spark, rows)
    got = {r.doc_id: r.class_id for r in neardup.op3_neardup(spark, SF).collect()}
    assert got == {d: want.get(d, d) for d, _ in rows}
    assert len(set(got.values())) < len(got)


def test_pairs_inside_a_template_shared_by_hundreds(spark):
    """Texts that share most of their weight, with pairs of near copies that no hub belongs to."""
    rng = np.random.default_rng(4)
    template = [f"t{i}" for i in range(1400)]
    rows = []
    for p in range(150):
        own = [f"p{p}w{i}" for i in range(16)]
        for side in range(2):
            end = [f"p{p}s{side}e{i}" for i in range(14 + p % 4)]
            rows.append((int(rng.integers(1 << 40)), " ".join(template + own + end)))
    want = brute_classes(spark, rows)
    assert len(set(want.values())) == 150                           # the pairs; the template alone links nothing
    got = {r.id: r["class"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_neardup_no_rows_and_blanks(spark, no_docs, edge_docs):
    assert neardup.classes(no_docs).count() == 0
    assert neardup.classes(edge_docs.filter("doc_id in (202, 203, 204)")).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2 ** 63, 600, dtype=np.int64).astype(np.uint64)
    sampler = neardup.Sampler(samples=2000)
    for common in (300, 450, 540):
        a, la = np.sort(h[:common + 30]), rng.integers(30, 50, common + 30)
        pick = np.concatenate([h[:common], h[570:600]])
        order = np.argsort(pick)
        lb = np.array([dict(zip(a.tolist(), la.tolist(), strict=True)).get(x, 40) for x in pick[order].tolist()])
        sa = sampler(a, la, np.array([0]))[:, 0]
        sb = sampler(pick[order], lb, np.array([0]))[:, 0]
        weight = lambda level: neardup.GRID ** (level + neardup.LOWEST)
        assert (sa == sb).mean() == pytest.approx(neardup.similarity((a, weight(la)), (pick[order], weight(lb))), abs=0.05)
        assert (neardup.levels(weight(la)) == la).all()
    high = np.full(len(a), 400)                                      # levels beyond the first table
    assert (sampler(a, high, np.array([0])) == neardup.Sampler(samples=2000)(a, high, np.array([0]))).all()
    assert sampler.levels == 401
