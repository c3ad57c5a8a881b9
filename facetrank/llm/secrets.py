"""Secret scans: three fixed patterns, and high-entropy runs found by a sliding window.

Patterns (leftmost, non-overlapping per kind): ``assign`` a named value of 8+ characters, ``access``
an access key id of 16+, ``hex`` a hexadecimal run of 32+.

Method: a candidate is a maximal run of 20+ key characters that holds a letter and a digit.  A window of
20 characters slides over it.  Counts per character, and per class (hexadecimal, digit, letter), change
by one entering and one leaving character, and with them the sum of c log2(c), kept in whole
millionths, so that nothing drifts.  A window of hexadecimal digits alone must reach 3.0 bits, a
mixed one (with a digit and a letter) 3.85 bits; the span runs from the first such window to the end of
the last.  Candidates on the allow-list, and those inside a pattern's span, add nothing.

Spans count code points, end exclusive.  Everything is a SQL expression over one row: no shuffle.

Edge cases: a null or empty text has no spans; ties at one start sort by kind; repeated rows each
get their own result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, prefix_max, prefix_sums

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.0, 3.85
#: Runs that look random and are not secret: UUIDs, dates and numbers with dashes, paths and slugs of
#: plain words, and documented example keys.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=+/-]+$",
    r"^[A-Za-z]?[a-z]*([/_=-]+([A-Za-z]?[a-z]*|[0-9]+))+$",
    r"EXAMPLE",
)
UNIT = 1_000_000


def _spans(text: Column, pattern: str, keep: str | None = None) -> Column:
    """array<struct(start, end)> of the matches; what lies between them gives their places.

    ``keep``: a group of the pattern of which 8+ characters are asked for.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(
        F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
    before = prefix_sums(F.transform(steps, lambda s: s["gap"] + s["len"]))
    spans = F.zip_with(before, steps, lambda p, s: F.struct(
        (p + s["gap"]).alias("start"), (p + s["gap"] + s["len"]).alias("end")))
    if keep is None:
        return spans
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(int(keep)))
    return F.filter(F.transform(F.arrays_zip(spans.alias("s"), F.transform(value, F.length).alias("n")),
                                lambda x: F.when(x["n"] >= 8, x["s"])), lambda s: s.isNotNull())


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"),
                                                 s["end"].alias("end")))


def entropy_windows(run: Column) -> Column:
    """struct(first, last, hex): ends of the high-entropy part of a run, -1 if there is none.

    One fold over the characters; the state is the window's counts and sums.
    """
    weigh = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(WINDOW + 1)])
    full = round(WINDOW * math.log2(WINDOW) * UNIT)

    def code(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(run, at, F.lit(1)))  # 1-based

    def is_hex(c: Column) -> Column:   # a-f, A-F, 0-9 by their places in the alphabet
        return c.between(1, 6) | c.between(27, 32) | c.between(53, 62)

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    def step(acc: Column, at: Column) -> Column:
        new, old = code(at), F.when(at > WINDOW, code(at - WINDOW)).otherwise(F.lit(0))
        moved = F.struct(new.alias("new"), old.alias("old"))
        return F.transform(F.array(moved), lambda m: F.struct(
            F.when(m["new"] == m["old"], acc["counts"]).otherwise(F.transform(
                acc["counts"], lambda c, i: c + one(i + 1 == m["new"]) - one(i + 1 == m["old"]))).alias("counts"),
            (acc["sum"] + F.when(m["new"] == m["old"], F.lit(0).cast("long")).otherwise(
                F.element_at(weigh, F.element_at(acc["counts"], m["new"]) + 2)
                - F.element_at(weigh, F.element_at(acc["counts"], m["new"]) + 1)
                + F.when(m["old"] > 0, F.element_at(
                    weigh, F.element_at(acc["counts"], F.greatest(m["old"], F.lit(1))))
                    - F.element_at(weigh, F.element_at(acc["counts"], F.greatest(m["old"], F.lit(1))) + 1))
                .otherwise(F.lit(0).cast("long")))).alias("sum"),
            (acc["hexes"] + one(is_hex(m["new"])) - one((m["old"] > 0) & is_hex(m["old"]))).alias("hexes"),
            (acc["digits"] + one(m["new"].between(53, 62)) - one(m["old"].between(53, 62))).alias("digits"),
            (acc["letters"] + one(m["new"].between(1, 52)) - one(m["old"].between(1, 52))).alias("letters"),
            acc["first"].alias("first"), acc["last"].alias("last"), acc["mixed"].alias("mixed")))[0]

    def judged(acc: Column, at: Column) -> Column:
        return F.transform(F.array(step(acc, at)), lambda s: F.transform(F.array(
            (at >= WINDOW) & F.when(
                s["hexes"] == WINDOW, F.lit(full) - s["sum"] >= round(HEX_BITS * WINDOW * UNIT)).otherwise(
                (s["digits"] > 0) & (s["letters"] > 0)
                & (F.lit(full) - s["sum"] >= round(MIXED_BITS * WINDOW * UNIT)))),
            lambda high: F.struct(
                s["counts"].alias("counts"), s["sum"].alias("sum"), s["hexes"].alias("hexes"),
                s["digits"].alias("digits"), s["letters"].alias("letters"),
                F.when(high & (s["first"] < 0), at - WINDOW).otherwise(s["first"]).alias("first"),
                F.when(high, at).otherwise(s["last"]).alias("last"),
                (s["mixed"] | (high & (s["hexes"] < WINDOW))).alias("mixed")))[0])[0]

    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("hexes"), F.lit(0).alias("digits"), F.lit(0).alias("letters"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(False).alias("mixed"))
    return F.aggregate(F.sequence(F.lit(1), F.length(run)), zero, judged, lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), s["mixed"].alias("mixed")))


def scan(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The rows of ``docs`` with ``_base`` and ``_spans``: array<struct(start, kind, end)> in order."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    df = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    t = F.col("_t")
    parts = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        spans = _tagged(_spans(t, pattern, "2" if name == "assign" else None), kind)
        parts.append(F.when(t.rlike(pattern), spans).otherwise(none))  # most texts stop at this test
    df = df.withColumn("_base", F.sort_array(F.concat(*parts)))
    runs = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    df = df.withColumn("_runs", F.when(t.rlike(CANDIDATE), F.transform(
        F.arrays_zip(_spans(t, CANDIDATE).alias("s"), runs.alias("run")),
        lambda x: F.struct(x["s"]["start"].alias("start"), x["run"].alias("run")))))
    allowed = "|".join(f"(?:{a})" for a in allow)
    df = df.withColumn("_runs", F.transform(F.filter(
        F.coalesce("_runs", F.array().cast("array<struct<start:bigint,run:string>>")),
        lambda r: r["run"].rlike("[A-Za-z]") & r["run"].rlike("[0-9]")
        & ~(r["run"].rlike(allowed) if allow else F.lit(False))),
        lambda r: F.struct(r["start"].alias("start"), entropy_windows(r["run"]).alias("w"))))
    more = F.transform(F.filter("_runs", lambda r: r["w"]["first"] >= 0), lambda r: F.struct(
        (r["start"] + r["w"]["first"]).cast("long").alias("start"),
        F.when(r["w"]["mixed"], KINDS.index("entropy_mixed")).otherwise(KINDS.index("entropy_hex")).alias("kind"),
        (r["start"] + r["w"]["last"]).cast("long").alias("end")))
    inside = lambda m, base: F.exists(base, lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"]))
    spans = let(F.col("_base"), lambda base: F.sort_array(F.concat(base, F.filter(more, lambda m: ~inside(m, base)))))
    return df.withColumn("_spans", spans).drop("_t", "_runs")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[redacted]") -> Column:
    """The text with each covered stretch replaced once by the mask.  ``spans`` in order; null stays null."""
    ends = F.transform(spans, lambda s: s["end"])
    # an uncovered gap runs from the furthest end so far to the next start
    gaps = F.transform(F.concat(prefix_max(ends), F.array(F.array_max(ends))), lambda e, i: F.struct(
        e.alias("from"), F.coalesce(F.get(spans, i)["start"], F.length(text).cast("long")).alias("to"), i.alias("i")))
    pieces = F.transform(
        F.filter(gaps, lambda g: (g["to"] > g["from"]) | (g["i"] == 0) | (g["i"] == F.size(spans))),
        lambda g: F.when(g["to"] > g["from"], F.substring(
            text, (g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int"))).otherwise(F.lit("")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, mask))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_entropy"))
