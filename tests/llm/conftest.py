import random

import pytest
from pyspark.sql import Row

SF = "/root/testdata/sf0.001"


def rows_with_edges(seed=3, n=40):
    """Texts with nulls, blanks, copies, near copies, shared passages, ties and one very long text."""
    rng = random.Random(seed)
    lex = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda k: [rng.choice(lex) for _ in range(k)]
    passage = words(60)
    out = []
    for i in range(n):
        w = words(rng.randint(30, 160))
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        sep = rng.choice([" ", "\n", "  ", "\t"])
        out.append((i, sep.join(w), ["en", "fr", None][i % 3], ["hot", "hot", "b", None][i % 4]))
    base = out[1][1].split()
    for j in range(6):                                   # near copies of document 1
        w = list(base)
        w[rng.randrange(len(w))] = "changed%d" % j
        out.append((100 + j, " ".join(w), "en", "hot"))
    out += [(200, out[2][1], "en", "b"), (201, out[2][1], "en", "hot"), (202, None, "en", "b"), (203, "", None, "hot"),
            (204, " \n\t ", "fr", None), (205, "one", "en", "b"), (206, "one two three", "en", "b"),
            (207, "Ünïcödé ß 漢字 😀 " * 30, "fr", "b"), (208, " ".join(words(60_000)), "en", "hot"),
            (209, "x" * 50_000, "en", "hot"), (210, "12345 678 " * 20, "en", "hot")]
    out.append(out[3])                                   # a repeated row
    return out


@pytest.fixture(scope="session")
def edge_rows():
    return rows_with_edges()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with columns whose names clash with those the operators use inside."""
    extra = ("slot", "block", "key", "part", "n", "id", "class", "ids", "queue", "score", "_row", "batch", "size")
    return spark.createDataFrame([Row(doc_id=d, text=t, lang=l, source=s, **dict.fromkeys(extra, 7))
                                  for d, t, l, s in edge_rows],
                                 "doc_id long, text string, lang string, source string, "
                                 + ", ".join(f"{x} int" for x in extra)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")
