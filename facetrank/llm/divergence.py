"""Audit of how the sources of a language differ in their words, by single-pass in-memory indexing.

A task reads its documents once and counts postings (lang, source, term) in memory: occurrences, and documents
that hold the term.  When POSTINGS of them are held, or the input ends, the block is spilled as a term-sorted run, cut by a
hash of the term into one message a shard.  The runs of a (lang, shard) are merged with a heap, which gives the
frequencies of each term over all sources at once; terms in fewer than ``least`` documents of the language end here.
A message holds at least one posting, so there are never more messages than there would be rows.

Divergences are streamed over the frequencies, chunk by chunk.  A term that occurs in neither of two sources adds the same
value whichever term it is, so a pair starts at V times that value; a shard then sends, for a pair, the sum of what its terms
with an occurrence in one of the two add beyond it.  Work is postings x sources of the language, and a shard
sends one row a source: one number a pair, and its TOP terms.

p = 1 + floor(UNIT * (count + 2) / (N + 2 V)) and f = floor((p - q)^2 / (p + q)) are exact: p by long division in base
1,000 (N + 2 V may be up to 9 * 10^15; beyond, it raises), and (p - q)^2 stays below 2^63.

Edge cases: a null text, lang or source is ''; a group without terms, or a language without kept terms, still has its
pairs; terms of any length; repeated rows are documents each; ties rank by the bytes of the item; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready, shuffle_partitions, written

LEAST = 10           # documents of a language that hold a kept term
UNIT = 1_000_000_000
TOP = 10
POSTINGS = 1_000_000  # postings held in memory before a run is spilled
CELLS = 1 << 20      # terms x sources worked on at once
LARGEST = 9 * 10 ** 15

# bytes that end a term become blanks, A-Z small letters; bytes of UTF-8 above 0x7F belong to terms
_TERM = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def shares(count: np.ndarray, over: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / over), exactly."""
    if over > LARGEST:
        raise ValueError("a group of more than 9 * 10**15 terms")
    out, rest = np.divmod(np.asarray(count, dtype=np.int64) + 2, over)
    for _ in range(3):                                   # UNIT = 1000**3
        digit, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _packed(terms: list[bytes], sources: list[str], of: list[int], n: list[int], docs: list[int]) -> bytes:
    import zstandard
    names = [s.encode() for s in sources]
    head = np.array([len(terms), len(names), *map(len, names)], "<i8").tobytes()
    return zstandard.compress(head + b"".join(names) + np.array([of, n, docs], "<i8").tobytes() + b" ".join(terms), 1)


def _unpacked(blob: bytes) -> tuple[list[bytes], list[str], list[int], list[int], list[int]]:
    import zstandard
    raw = zstandard.decompress(blob)
    size, k = np.frombuffer(raw, "<i8", 2).tolist()
    at, names = 16 + 8 * k, []
    for n in np.frombuffer(raw, "<i8", k, 16).tolist():
        names.append(raw[at:at + n].decode())
        at += n
    of, n, docs = np.frombuffer(raw, "<i8", 3 * size, at).reshape(3, size).tolist()
    return raw[at + 24 * size:].split(), names, of, n, docs


def runs(rows: DataFrame, shards: int) -> DataFrame:
    """lang, shard, message: the term-sorted runs, cut by shard."""
    kind = [("lang", pa.string()), ("shard", pa.int32()), ("message", pa.binary())]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        counts: dict[tuple[str, str], Counter] = {}
        holding: dict[tuple[str, str], Counter] = {}

        def spill() -> Iterator[pa.RecordBatch]:
            for lang in sorted({g[0] for g in counts}):
                sources = sorted(g[1] for g in counts if g[0] == lang)
                cut: dict[int, list] = {}
                for i, source in enumerate(sources):
                    docs = holding[lang, source]
                    for term, n in counts[lang, source].items():
                        cut.setdefault(xxhash.xxh3_64_intdigest(term) % shards, []).append((term, i, n, docs[term]))
                made = []
                for shard, postings in sorted(cut.items()):
                    postings.sort()
                    term, of, n, docs = zip(*postings, strict=True)
                    made.append(_packed(list(term), sources, list(of), list(n), list(docs)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(made), pa.string()), pa.array(sorted(cut), pa.int32()), pa.array(made, pa.binary())],
                    names=[k for k, _ in kind])
            counts.clear()
            holding.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"),
                                          strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                own = counts.setdefault((lang, source), Counter())
                before = len(own)
                own.update(found)
                holding.setdefault((lang, source), Counter()).update(set(found))
                held += len(own) - before
                if held >= POSTINGS:
                    yield from spill()
                    held = 0
        yield from spill()

    return rows.mapInArrow(index, "lang string, shard int, message binary")


def frequencies(spilled: DataFrame, least: int) -> DataFrame:
    """lang, shard, term, sources, counts of the kept terms.  Written once."""
    def merge(table: pa.Table) -> pa.Table:
        number: dict[str, int] = {}
        streams = []
        for m in table.column("message").to_pylist():
            terms, names, of, n, docs = _unpacked(m)
            own = [number.setdefault(s, len(number)) for s in names]
            streams.append(zip(terms, [own[i] for i in of], n, docs, strict=True))
        names = list(number)
        out: tuple[list, list, list] = ([], [], [])
        term, at, docs = None, {}, 0

        def close() -> None:
            if docs >= least:
                out[0].append(term)
                out[1].append([names[i] for i in at])
                out[2].append(list(at.values()))

        for t, i, n, d in heapq.merge(*streams):
            if t != term:
                close()
                term, at, docs = t, {}, 0
            at[i] = at.get(i, 0) + n
            docs += d
        close()
        return pa.table([pa.array(table.column("lang").to_pylist()[:1] * len(out[0]), pa.string()),
                         pa.array(table.column("shard").to_pylist()[:1] * len(out[0]), pa.int32()),
                         pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.list_(pa.string())),
                         pa.array(out[2], pa.list_(pa.int64()))], names=["lang", "shard", "term", "sources", "counts"])

    return written(spilled.groupBy("lang", "shard").applyInArrow(
        merge, "lang string, shard int, term string, sources array<string>, counts array<long>"), "audit-frequencies")


def _streamed(left: pa.Table, right: pa.Table) -> pa.Table:
    """What one shard of a language adds: for each source the corrections of its pairs with all sources (in order), and its
    top terms."""
    out: tuple = ([], [], [])
    if left.num_rows and right.num_rows:
        right = right.sort_by("source")
        sources = right.column("source").to_pylist()
        number = {s: i for i, s in enumerate(sources)}
        over = right.column("over").to_pylist()
        all_over = right.column("all_over")[0].as_py()
        s = len(sources)
        zero = np.array([int(shares(np.int64(0), o)) for o in over])
        none = apart(zero[:, None], zero[None, :])
        pairs = np.zeros((s, s), dtype=np.int64)
        best: list[list] = [[] for _ in sources]
        order = np.argsort(np.array([t.encode() for t in left.column("term").to_pylist()], dtype=object), kind="stable")
        left = left.take(pa.array(order))
        step = max(1, CELLS // s)
        for at in range(0, left.num_rows, step):
            some = left.slice(at, step)
            terms = some.column("term").to_pylist()
            lists, values = some.column("sources").combine_chunks(), some.column("counts").combine_chunks()
            rows = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
            columns = np.fromiter(map(number.__getitem__, lists.flatten().to_pylist()), dtype=np.int64, count=len(rows))
            count = np.zeros((len(terms), s), dtype=np.int64)
            count[rows, columns] = values.flatten().to_numpy()
            p = np.stack([shares(count[:, j], over[j]) for j in range(s)], axis=1)
            whole = shares(count.sum(1), all_over)
            for j in range(s):
                has = np.flatnonzero(count[:, j])
                if not len(has):
                    continue
                more = apart(p[has, j, None], p[has]) - none[j]
                # terms that both hold come up for either source: count them for the first
                pairs[j] += (more * ((count[has] == 0) | (np.arange(s) > j))).sum(0)
                q = whole[has]
                up = has[p[has, j] > q]
                value = apart(p[up, j], whole[up])
                top = np.argsort(-value, kind="stable")[:TOP]        # of equal values the least term
                best[j] = heapq.nsmallest(TOP, best[j] + [(-int(value[i]), terms[up[i]].encode()) for i in top])
        pairs = pairs + pairs.T
        out = (sources, pairs.tolist(), [[{"value": -v, "item": t.decode()} for v, t in found] for found in best])
    lang = left.column("lang").to_pylist()[:1]
    return pa.table([pa.array(lang * len(out[0]), pa.string()), pa.array(out[0], pa.string()), pa.array(out[1], _PAIRS),
                     pa.array(out[2], _TERMS)], names=["lang", "source", "pairs", "terms"])


def _merged(table: pa.Table) -> pa.Table:
    """The sums of a source's pairs over all shards, and its top terms."""
    pairs = sum(np.array(x, dtype=np.int64) for x in table.column("pairs").to_pylist())
    terms = heapq.nsmallest(TOP, (t for x in table.column("terms").to_pylist() for t in x),
                            key=lambda t: (-t["value"], t["item"].encode()))
    return pa.table([table.column("lang").slice(0, 1), table.column("source").slice(0, 1), pa.array([pairs.tolist()], _PAIRS),
                     pa.array([terms], _TERMS)], names=["lang", "source", "pairs", "terms"])


_PAIRS = pa.list_(pa.int64())
_TERMS = pa.list_(pa.struct([("value", pa.int64()), ("item", pa.string())]))
STREAMED = "lang string, source string, pairs array<bigint>, terms array<struct<value:bigint,item:string>>"


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least: int = LEAST) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    ready(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"),
                       blank(text_col).cast("binary").alias("text"))
    kept = frequencies(runs(rows, shuffle_partitions(spark)), least)
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"),
                                    F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all_n"))
    own = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")) \
        .groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(size, "lang", "left")
    groups = written(groups.select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).cast("long").alias("over"),
        (F.coalesce("all_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).cast("long").alias("all_over")), "audit-groups")
    shards = kept.select(F.col("lang").alias("of"), F.col("shard").alias("part")).distinct()
    there = shards.join(groups, F.col("of") == F.col("lang")).drop("lang")     # the groups go with each shard
    streamed = kept.groupBy("lang", "shard").cogroup(there.groupBy("of", "part")).applyInArrow(_streamed, STREAMED)
    merged = streamed.groupBy("lang", "source").applyInArrow(_merged, STREAMED)

    everyone = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "over"))).alias("everyone"))
    rows = written(groups.join(everyone, "lang").join(merged, ["lang", "source"], "left"), "audit-merged")
    zero = lambda of: F.expr(f"1L + {2 * UNIT}L div nullif({of}, 0)")
    pairs = rows.select("lang", "source", "v", "pairs", zero("over").alias("p"), F.posexplode("everyone").alias("i", "other"))
    pairs = pairs.filter(F.col("other.source") != F.col("source")).select(
        "lang", "source", "v", "p", zero("other.over").alias("q"), F.col("other.source").alias("item"),
        F.coalesce(F.get("pairs", F.col("i")), F.lit(0)).alias("more"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("more") + F.coalesce(
        F.col("v") * F.expr("((p - q) * (p - q)) div (p + q)"), F.lit(0).cast("long"))).alias("value"))
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.explode("terms").alias("t")).select(
        "lang", "source", "part", "t.item", "t.value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir).select("lang", "source", "text"))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term
  GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
whole AS (SELECT lang, sum(n) AS n FROM counts GROUP BY lang),
term_n AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(o.n, 0) + 2 * s.v) AS p
  FROM grps g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT t.lang, t.term, 1 + ({UNIT}::HUGEINT * (t.n + 2)) // (w.n + 2 * s.v) AS q
  FROM term_n t JOIN whole w ON w.lang = t.lang JOIN size s ON s.lang = t.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {TOP}
"""
