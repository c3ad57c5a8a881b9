import random
import re
from collections import Counter

import numpy as np
import pytest

from facetrank.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=divergence.LEAST, top=divergence.TOP):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, c in held.items() if c >= least)
        count = {s: Counter() for _, s, _ in own}
        for _, s, ts in own:
            count[s].update(t for t in ts if held[t] >= least)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def audited(docs, **given):
    got = divergence.audit(docs, **given).collect()
    found = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}
    assert len(found) == len(got)
    return found


def test_against_brute_force(spark, edge_docs, edge_rows, no_docs):
    want = brute([(lang, s, t) for _, t, lang, s in edge_rows], 4)
    assert len(want) > 30 and ("", "") in {(w[0], w[1]) for w in want}
    assert audited(edge_docs, least=4) == want
    assert audited(no_docs) == set()


@pytest.mark.parametrize("small", [False, True])
def test_many_sources_ties_and_spills(spark, monkeypatch, small):
    rng = random.Random(7)
    lex = ["w%s" % "".join(rng.choice("abÉéＺz") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(rng.choice(["a", "b", None]), "s%d" % int(rng.random() ** 3 * 40), " 1_".join(rng.choice(lex).title() for _ in range(rng.randint(0, 25))))
            for _ in range(700)]
    rows += [("few", "x", "alone"), ("few", "y", "here"), ("few", None, None), ("one", "z", "w " * 30), ("tie", "p", "aa bb cc"),
             *[("tie", "q", "aa bb cc")] * 12, ("a", "s\nline", "wab"), ("a", "no words", "12 34")]
    if small:                                            # runs of a few postings, chunks of a few terms
        monkeypatch.setattr(divergence, "POSTINGS", 50)
        monkeypatch.setattr(divergence, "CELLS", 100)
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "lang string, source string, text string, shard int, part int")
    assert audited(docs.repartition(3)) == brute(rows)


def test_exact_shares():
    rng = random.Random(1)
    for _ in range(300):
        over = rng.randint(1, 10 ** rng.randint(1, 15))
        n = rng.randint(0, over)
        assert int(divergence.shares(np.int64(max(0, n - 2)), over)) == 1 + 10 ** 9 * (max(0, n - 2) + 2) // over
    with pytest.raises(ValueError, match="9 \\* 10"):
        divergence.shares(np.int64(1), 10 ** 16)


def test_runs_round_trip():
    rows = (["é".encode(), b"z"], ["", "s\n x"], [1, 0], [5, 2 ** 40], [1, 2])
    assert divergence._unpacked(divergence._packed(*rows)) == rows
