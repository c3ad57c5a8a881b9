import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from facetrank.llm import private

from .conftest import SF

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def base(text):
    """The patterns as they are given."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checksum(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


TEXTS = [
    "a@b.c_d@e.f x@y @z.q a.@b-.c..d %@1.2 é@x.y q@é.z a@b@c.d a@b.c@d.e", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1 1..2.3.4 .9.9.9.9. 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 4111  1111 41111111111111110000 ٤١١١١١١١١١١١١١١١",
    "+1 (607) 555-1595 +1 2 +123456789012345 +1234567890123456 ++1 23 45 678 +49.30-1234567) +1 (607) 555-1595 4111111111111111",
    "", "@", "+", "a" * 3000 + "@b.c", "1" * 5000, "9" * 30 + ".1.1.1", "1 " * 400, "+1" * 300, "😀 a@b.cd 😀 1.2.3.4", "a@b." + "c." * 300,
]


def test_base_spans_match_the_patterns(spark):
    texts = TEXTS + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab1290@@..+-_ ()é") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for t in texts:
        assert private.base_spans(t) == base(t), t
    assert sum(len(base(t)) for t in texts) > 300


def segmentations(ends, j):
    """All segmentations of the tokens up to j, as lists of (kind, first, end)."""
    if j == 0:
        yield []
        return
    for kind, i, _ in ends[j]:
        for before in segmentations(ends, i):
            yield [*before, (kind, i, j)]


def small_model(seed):
    rng = random.Random(seed)
    model = private.Model({}, [[rng.gauss(0, 1) for _ in range(5)] for _ in range(5)], frozenset(range(4)))
    return model, rng


@pytest.mark.parametrize("text", ["call 1234567 1.2.3.4 x", "a.b @ c.d 99 e", "(607) 555-1595 77", "no", "x at y dot z", "12 345 6789 01234"])
def test_dynamic_program_against_all_segmentations(text):
    model, rng = small_model(len(text))
    tokens = private.cut(text)
    assert "".join(tokens) == text
    ends = model.segments(tokens)
    model.weights = {(k, f): rng.gauss(0, 1) for e in ends for k, _, found in e for f in found}
    found = {(k, i, j): f for j, e in enumerate(ends) for k, i, f in e}

    def score(segments):
        kinds = [private.NONE, *[k for k, _, _ in segments]]
        return sum(model.score(x[0], found[x]) for x in segments) + sum(model.pairs[a][b] for a, b in itertools.pairwise(kinds))

    every = [(score(s), s) for s in segmentations(ends, len(tokens))]
    best = max(every, key=lambda x: x[0])[1]
    assert model.best(tokens) == [x for x in best if x[0] != private.NONE]
    total, segment, pairs = model.expected(ends)
    z = sum(math.exp(s) for s, _ in every)
    assert total == pytest.approx(math.log(z))
    for j, e in enumerate(ends):
        for (k, i, _), p in zip(e, segment[j] if j else [], strict=True):
            assert p == pytest.approx(sum(math.exp(s) for s, x in every if (k, i, j) in x) / z, abs=1e-9)
    assert sum(pairs.values()) == pytest.approx(sum(math.exp(s) / z * len(x) for s, x in every))


@pytest.fixture(scope="module")
def made():
    """Labelled stretches of each kind."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghilmnorstuü") for _ in range(rng.randint(2, 8)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def piece(kind):
        if kind == 0:
            return f"{word().replace('ü', 'u')}.{d(2)}@{rng.choice(['mail', 'post'])}{d(1)}.{rng.choice(['example.com', 'site.org'])}"
        if kind == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            s = "4" + d(14)
            return next(s + c for c in "0123456789" if private.luhn(s + c))
        return f"+1 ({d(3)}) {d(3)}-{d(4)}"

    out = []
    for n in range(700):
        kind = n % 5
        left, right = (" ".join(word() for _ in range(6)) for _ in range(2))
        mid = piece(kind) if kind < 4 else private.look_alike(rng)
        text = f"{left} {mid} {right}"
        out.append((text, private.base_spans(text)))
    return out


def test_learned_on_rewritten_forms(made):
    model = private.learned(private.examples(made[:400]))
    assert model.kinds == frozenset(range(4))
    hits = wrong = missed = 0
    for tokens, gold in private.examples(made[400:], seed=4):
        got = set(model.best(tokens))
        hits, wrong, missed = hits + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hits / (hits + missed) > 0.97 and hits / (hits + wrong) > 0.97
    # neighbours that one pattern swallows: boundaries and kinds are chosen together
    text = "stha +1 (269) 555-3296 4111111111111111 onre"
    assert private.base_spans(text) == []
    assert [(k, text[s:e]) for k, s, e in private.added_spans(text, [], model)] == [
        (3, "+1 (269) 555-3296"), (2, "4111111111111111")]
    for text in ("in 1999-2003 at 12:30:00 for 12,300.50", "v 1.2.3 and 978-3-16-148410-0", "no number at all", "", "dot at dot"):
        assert private.added_spans(text, private.base_spans(text), model) == []


def test_scan_edges(spark, edge_docs, no_docs, made):
    model = private.learned(private.examples(made[:200]), epochs=2)
    rows = list(enumerate([*TEXTS, None, "12 345 6789 " * 3000, "é" * 20000 + " a@b.cd"]))
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, base int, added int")
    got = {r.doc_id: r for r in private.scan(docs, model).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own = base(t or "") if i != len(rows) - 1 else private.base_spans(t)
        assert [tuple(x) for x in got[i].base] == own
        free = sorted([(x.start, x.end) for x in got[i].added] + [(s, e) for _, s, e in own])
        assert all(x.start < x.end <= len(t) for x in got[i].added)
        for x in got[i].added:
            assert not any(s < x.end and e > x.start for _, s, e in own)
        assert free == sorted(free)
    assert private.scan(edge_docs, model, keep=("doc_id", "slot")).count() == edge_docs.count()
    assert private.scan(no_docs, model).count() == 0
    none = private.fit(no_docs)
    assert none.kinds == frozenset() and private.added_spans("a@b.cd (607) 555-1595", [], none) == []


def test_query(spark):
    got = {r.doc_id: r for r in private.op13_private(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        own, g = base(r.text or ""), got[r.doc_id]
        text = lambda spans: ",".join(f"{private.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x[0] == k for x in own) for k in range(4)]
        assert g.base_sha256 == hashlib.sha256(text(own).encode()).hexdigest()
        every = [x.split(":") for x in g.spans.split(",") if x]
        every = [(private.KINDS.index(k), int(s), int(e)) for k, s, e in every]
        assert every == sorted(every) and set(own) <= set(every) and len(every) == len(own) + g.n_added
    first = private.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    again = private.fit(spark.read.parquet(f"{SF}/documents.parquet").repartition(5, F.col("doc_id")))
    assert first.weights == again.weights                # the sample is a function of the rows
