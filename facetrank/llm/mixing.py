"""Mixing sources to target weights by proportional-fair (Pfair) scheduling.

A source's records, in a fixed pseudo-random order, are cut into blocks of equal bytes.  Time is
counted in slots, one block each.  A source of weight n/P (n slots of a period of P) gives its
block i the release time floor(i P / n) and the deadline ceil((i+1) P / n).  In each slot the
released block with the earliest deadline goes next (lowest source on ties).  Weights sum to one,
so after any number t of slots every source that still has blocks has been served within less than
one block of t n / P.  The pattern repeats after P slots, so P slots are worked out once, as one
fold, and every block finds its slot by arithmetic.

A source that has run dry leaves its slots empty; the others keep their proportions.  Nothing is
dropped or repeated: the mixed order is (slot, offset), over all records.

Edge cases: a null source is a source of its own; a null text has no bytes (size 1); repeated
rows take adjacent offsets; an empty table gives no rows; other columns pass through, and those
named like a result column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready, small_table

PERIOD = 1000          # slots of a period: weights are multiples of 1/PERIOD
BLOCK_BYTES = 65_536   # bytes of a block
QUEUES = 256           # sources with a queue of their own, largest first; the others share one
BUCKETS = 4096         # pieces of each source's order, each sorted by itself
RESULT = ("size", "queue", "block", "slot", "release", "deadline", "offset")


def shares(weights: dict[int, int], period: int = PERIOD) -> dict[int, int]:
    """Slots per period: one each, the rest in proportion to the weights (largest remainders)."""
    if not weights:
        return {}
    total, spare = sum(weights.values()), period - len(weights)
    if spare < 0:
        raise ValueError("more queues than slots in a period")
    got = {q: 1 + w * spare // total for q, w in weights.items()}
    left = period - sum(got.values())
    for q in sorted(weights, key=lambda q: (-(weights[q] * spare % total), q))[:left]:
        got[q] += 1
    return got


def schedule(spark: SparkSession, slots_of: dict[int, int], period: int = PERIOD) -> DataFrame:
    """queue, k, slot, release, deadline of every block of one period, by earliest deadline first."""
    names = sorted(slots_of)
    n = F.array(*[F.lit(slots_of[q]).cast("int") for q in names])
    zero = F.struct(F.array_repeat(F.lit(0), len(names)).alias("served"),
                    F.array().cast("array<int>").alias("picks"))

    def step(acc: Column, t: Column) -> Column:
        # (deadline, queue) of the next block of each source, null while it is not released
        due = F.transform(F.arrays_zip(acc["served"].alias("d"), n.alias("n")), lambda x, i: F.when(
            F.floor(x["d"] * period / x["n"]) <= t,
            F.struct(F.ceil((x["d"] + 1) * period / x["n"]).cast("int").alias("deadline"), i.alias("q"))))
        pick = F.array_min(due)["q"]
        return F.struct(
            F.transform(acc["served"], lambda s, i: F.when(i == pick, s + 1).otherwise(s)).alias("served"),
            F.concat(acc["picks"], F.array(pick)).alias("picks"))

    picks = spark.range(1).select(F.posexplode(F.aggregate(
        F.sequence(F.lit(0), F.lit(period - 1)), zero, step, lambda acc: acc["picks"])).alias("slot", "q"))
    k = F.row_number().over(Window.partitionBy("q").orderBy("slot")) - 1
    own = F.element_at(n, F.col("q") + 1)
    return picks.withColumn("k", k).select(
        F.element_at(F.array(*[F.lit(q) for q in names]), F.col("q") + 1).alias("queue"), "k", "slot",
        F.floor(F.col("k") * period / own).alias("release"),
        F.ceil((F.col("k") + 1) * period / own).alias("deadline"), own.alias("n"))


def totals(rows: DataFrame, targets: dict | None) -> list[tuple]:
    """(source, bytes) of the largest (targeted) sources, and one total of the others: at most QUEUES rows."""
    t = rows.groupBy("_source").agg(F.sum("_size").alias("bytes"))
    if targets is not None:
        named = F.col("_source").isin([x for x in targets if x is not None])
        t = t.filter(F.coalesce(named, F.lit(None in targets)))
    rank = t.orderBy(F.col("bytes").desc(), F.col("_source").asc_nulls_first()).limit(QUEUES - 1)
    top = [(r["_source"], r["bytes"]) for r in rank.collect()]
    if targets is None and len(top) < QUEUES - 1:
        return [(s, b, False) for s, b in top]
    rest = (rows.agg(F.sum("_size")).first()[0] or 0) - sum(b for _, b in top)
    return [(s, b, False) for s, b in top] + ([(None, rest, True)] if rest else [])


def in_order(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """hash, id, size and checksum of a row: rows of a queue sorted by them are in the order of (slot, offset)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10)
            .cast("long").alias("_h"), F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc")]


def allotted(rows: DataFrame, targets: dict[str | None, int] | None = None,
             period: int = PERIOD) -> tuple[list[tuple], dict[int, int]]:
    """(source, bytes, whether shared) of the queues by number, and their slots, for rows with _source and _size."""
    found = totals(rows, targets)
    # queues are numbered by name; a null source first, the shared queue last
    found.sort(key=lambda x: (x[2], x[0] is not None, str(x[0])))
    weights = {i: (targets[s] if targets is not None and not r else max(1, math.isqrt(b)))
               for i, (s, b, r) in enumerate(found)}
    return found, shares(weights, period)


def mix(docs: DataFrame, targets: dict[str | None, int] | None = None, period: int = PERIOD,
        block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``keep``, or all) with size, queue, block, slot, release, deadline and offset.

    ``targets`` gives whole-number weights; by default a source weighs the square root of its bytes
    (temperature 1/2).  Sources without a weight of their own share one queue, with the weight of
    what they hold together under the default rule.  The driver sees at most QUEUES totals.
    """
    spark = docs.sparkSession
    ready(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
                       F.col(source_col).alias("_source"), *in_order(id_col, text_col))
    found, slots = allotted(rows.select("_source", "_size"), targets, period)
    plan = schedule(spark, slots, period) if slots else small_table(
        spark, [], [("queue", "int"), ("k", "int"), ("slot", "int"), ("release", "long"), ("deadline", "long"),
                    ("n", "int")])
    shared = next((i for i, x in enumerate(found) if x[2]), None)
    names = small_table(spark, [(s, i) for i, (s, _, r) in enumerate(found) if not r],
                        [("_name", "string"), ("queue", "int")])
    rows = rows.join(F.broadcast(names), F.col("_source").cast("string").eqNullSafe(F.col("_name")), "left").drop("_name")
    rows = rows.withColumn("queue", F.coalesce("queue", F.lit(shared).cast("int")))
    rows = rows.withColumn("_bucket", F.floor(F.col("_h") * BUCKETS / 2**32).cast("int"))
    # a source may hold a third of all rows: sort each of its buckets by itself, then add up bucket totals
    group = rows.groupBy("queue", "_bucket").agg(F.sum("_size").alias("_all"))
    before = (F.sum("_all").over(Window.partitionBy("queue").orderBy("_bucket")) - F.col("_all"))
    group = group.select("queue", "_bucket", before.alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("queue", "_bucket").orderBy("_h", "_id", "_size", "_crc")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_inside", inside - F.col("_size")).join(group, ["queue", "_bucket"])
    rows = rows.withColumn("_start", F.col("_before") + F.col("_inside"))
    rows = rows.withColumn("block", F.floor(F.col("_start") / block_bytes).cast("long"))
    n = plan.groupBy("queue").agg(F.max("n").alias("n"))
    rows = rows.join(F.broadcast(n), "queue").withColumn("k", F.pmod(F.col("block"), F.col("n")).cast("int"))
    rows = rows.join(F.broadcast(plan.drop("n")), ["queue", "k"])
    base = F.floor(F.col("block") / F.col("n")).cast("long") * period
    return rows.select("_row.*", F.col("_size").alias("size"), F.col("queue").cast("int").alias("queue"), "block",
                       (base + F.col("slot")).alias("slot"), (base + F.col("release")).alias("release"),
                       (base + F.col("deadline")).alias("deadline"),
                       (F.col("_start") - F.col("block") * block_bytes).alias("offset"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", *RESULT)


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(octet_length(encode(coalesce(text, ''))), 0) + 1 AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, greatest(1, CAST(floor(sqrt(sum(size))) AS BIGINT)) AS w FROM d GROUP BY source),
q AS (SELECT source, w, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS queue FROM s),
t AS (SELECT sum(w)::BIGINT AS tw, {PERIOD} - count(*) AS spare FROM q),
b AS (SELECT queue, source, 1 + (w * spare) // tw AS base, (w * spare) % tw AS rem FROM q, t),
l AS (SELECT {PERIOD} - sum(base)::BIGINT AS left_over FROM b),
n AS (SELECT queue, source, base + (CASE WHEN row_number() OVER (ORDER BY rem DESC, queue) <= left_over
        THEN 1 ELSE 0 END) AS n FROM b, l),
arr AS (SELECT list(n ORDER BY queue) AS ns FROM n),
sched AS (
  SELECT -1 AS slot, -1::BIGINT AS pick, [0::BIGINT for x in ns] AS served, ns FROM arr
  UNION ALL
  SELECT slot + 1, p, [CASE WHEN i - 1 = p THEN served[i] + 1 ELSE served[i] END for i in range(1, len(ns) + 1)], ns
  FROM (SELECT slot, served, ns, list_min([
          CASE WHEN (served[i] * {PERIOD}) // ns[i] <= slot + 1
               THEN ((((served[i] + 1) * {PERIOD}) + ns[i] - 1) // ns[i]) * 100000 + i - 1
               ELSE 9000000000000000 END for i in range(1, len(ns) + 1)]) % 100000 AS p
        FROM sched WHERE slot < {PERIOD} - 1)),
plan AS (SELECT pick AS queue, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k, slot
         FROM sched WHERE slot >= 0),
pos AS (
  SELECT d.doc_id, d.source, d.size, n.queue, n.n,
         sum(d.size) OVER (PARTITION BY n.queue ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS st
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
blk AS (SELECT *, (st // {BLOCK_BYTES})::BIGINT AS block FROM pos)
SELECT doc_id, source, size::BIGINT AS size, blk.queue::INTEGER AS queue, block,
       ((block // n) * {PERIOD} + slot)::BIGINT AS slot,
       ((block // n) * {PERIOD} + (k * {PERIOD}) // n)::BIGINT AS release,
       ((block // n) * {PERIOD} + ((k + 1) * {PERIOD} + n - 1) // n)::BIGINT AS deadline,
       (st - block * {BLOCK_BYTES})::BIGINT AS "offset"
FROM blk JOIN plan ON blk.queue = plan.queue AND blk.block % blk.n = plan.k
"""
