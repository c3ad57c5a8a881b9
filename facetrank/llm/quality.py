"""Quality rules with risk-controlled thresholds.

Each text gets a few measures.  A rule rejects texts whose measure lies on the wrong side of a cutoff.
Cutoffs come from labelled texts (quality 1 is good): per stratum (language) and measure, the
strictest cutoff of a fixed grid whose false rejection rate is certified to be at most RISK shared
among the measures.  A cutoff is certified if, among n good texts, it rejects k and the exact
binomial tail P(Bin(n, risk) <= k) is small enough, which is the exact (Clopper-Pearson) upper bound read
as a test.  Multiple tests: the grid is walked from lax to strict and left at the first failure
(fixed-sequence testing, no loss), and DELTA is divided among strata and measures (Bonferroni).  So with
probability 1 - DELTA no stratum loses more than RISK of its good texts to these rules.  A stratum
with too few labelled texts certifies nothing and loses none.

The base rules hold besides: fewer than 50 words, or over half of the words in repeated 3-word windows.

Edge cases: a null text has no words; an empty label table certifies nothing; several labels of a
document count as one, good if any is; a null language is a stratum of its own; repeated rows each
get a result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, let, ready, words_of, written

RISK = 0.02     # false rejections of good texts allowed in a stratum
DELTA = 0.05    # chance that any certificate is wrong
#: measure -> (rejected above (+1) or below (-1) the cutoff, grid from lax to strict)
GRID = {
    "symbol_pct": (1, [60, 50, 40, 30, 25, 20, 15, 10, 8, 5, 3, 2, 1]),      # symbols per 100 word characters
    "repeat_pct": (1, [95, 90, 80, 70, 60, 50, 40, 30, 25, 20, 15, 10]),     # repeated words per 100 words
    "dup_line_pct": (1, [90, 80, 70, 60, 50, 40, 30, 20, 15, 10, 5]),        # repeated lines per 100 lines
    "long_word": (1, [40, 30, 25, 20, 18, 16, 14, 12, 11, 10]),              # mean word length
    "short_word": (-1, [1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5]),
    "upper_pct": (1, [95, 90, 80, 70, 60, 50, 40, 30, 25, 20]),              # capitals per 100 letters
    "stop_pct": (-1, [0.5, 1, 2, 3, 4, 5, 6, 8, 10, 12]),                    # 2-3 character words per 100 words
}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lines", "_stop", "_upper", "_letters")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    A window is a hash of its words' hashes, packed above its place in the text; sorting these longs
    puts equal windows side by side, and the words of neighbours are then compared.
    """
    one = F.lit(1).cast("long")

    def cover(w: Column, low: Column, win: Column) -> Column:
        at = lambda x: x.bitwiseAND(low - 1).cast("int")

        def same(a: Column, b: Column) -> Column:
            return F.coalesce((a.bitwiseAND(-low) == b.bitwiseAND(-low)) & (F.get(w, at(a)) == F.get(w, at(b)))
                              & (F.get(w, at(a) + 1) == F.get(w, at(b) + 1))
                              & (F.get(w, at(a) + 2) == F.get(w, at(b) + 2)), F.lit(False))

        twice = F.filter(win, lambda x, i: same(x, F.get(win, i - 1)) | same(x, F.get(win, i + 1)))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low - 1))),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")),
            lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["to"])).alias("n"), (p + 3).alias("to")),
            lambda acc: acc["n"])

    def windows(h: Column, low: Column) -> Column:
        return F.sort_array(F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(
            x, F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(-low).bitwiseOR(i.cast("long"))))

    # places take as many low bits as the number of words needs
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(
        let(F.call_function("shiftleft", one, F.length(F.bin(F.size(words).cast("long")))), lambda low:
            let(F.transform(words, lambda x: F.xxhash64(x)), lambda h:
                let(windows(h, low), lambda win: cover(words, low, win)))))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ``_stop``,
    ``_upper``, ``_letters`` and ``_lines``."""
    def of(text: Column, w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"), F.size(lines).alias("_lines"),
            F.size(F.filter(w, lambda x: F.length(x).between(2, 3))).alias("_stop"),
            F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("_upper"),
            F.length(F.regexp_replace(text, r"\P{L}+", "")).alias("_letters"))

    def lines_of(text: Column) -> Column:
        return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")

    m = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: let(words_of(t), lambda w: let(
        lines_of(t), lambda lines: of(t, w, lines))))
    return docs.withColumn("_m", m).select(*[F.col(f"`{c}`") for c in docs.columns], "_m.*")


def _pct(a: str, b: str) -> Column:
    return 100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1))


MEASURES = {
    "symbol_pct": lambda: _pct("n_symbols", "word_chars"),
    "repeat_pct": lambda: _pct("n_repeat_words", "n_words"),
    "dup_line_pct": lambda: _pct("n_dup_lines", "_lines"),
    "long_word": lambda: _pct("word_chars", "n_words") / 100,
    "short_word": lambda: _pct("word_chars", "n_words") / 100,
    "upper_pct": lambda: _pct("_upper", "_letters"),
    "stop_pct": lambda: _pct("_stop", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k): the top term by its logarithm, the others by their ratios to it."""
    log_top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>")),
        n * math.log1p(-risk), lambda acc, i: acc + F.log((n - i + 1) / i) + math.log(risk) - math.log1p(-risk))
    ratio = (1 - risk) / risk
    sums = F.aggregate(
        F.when(k > 0, F.reverse(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))))).otherwise(
            F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * i / (n - i + 1) * ratio).alias("term"),
            (acc["sum"] + acc["term"] * i / (n - i + 1) * ratio).alias("sum")),
        lambda acc: acc["sum"])
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(log_top) * sums)


def cutoffs(rows: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK,
            delta: float = DELTA) -> DataFrame:
    """stratum, measure, cutoff: the strictest certified cutoffs.

    Good texts are counted against the grid with one partial aggregate per stratum; what reaches the
    binomial tests is one row per stratum and grid point.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_q")).filter("_q = 1").select("doc_id")
    held = rows.join(good, "doc_id", "left_semi")
    ok = ~base_failed()
    share = risk / len(GRID)
    counts = []
    for name, (sign, grid) in GRID.items():
        m = MEASURES[name]()
        counts += [F.sum(F.when(ok & ((m > c) if sign > 0 else (m < c)), 1).otherwise(0)).cast("long").alias(f"{name}:{i}")
                   for i, c in enumerate(grid)]
    per = held.groupBy(F.col(stratum).alias("_stratum")).agg(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("n"), *counts)
    tests = F.array(*[F.struct(F.lit(name).alias("measure"), F.lit(i).alias("strict"), F.lit(float(c)).alias("cutoff"),
                               F.col(f"`{name}:{i}`").alias("k"))
                      for name, (_, grid) in GRID.items() for i, c in enumerate(grid)])
    strata = per.agg(F.count(F.lit(1))).scalar()
    per = per.select("_stratum", "n", F.explode(tests).alias("t"))
    sure = binomial_tail(F.col("n"), F.col("t.k"), share) <= delta / (len(GRID) * strata)
    failed = F.min(F.when(~F.col("_sure"), F.col("t.strict"))).over(Window.partitionBy("_stratum", "t.measure"))
    return (per.withColumn("_sure", sure).withColumn("_failed", failed)
            .filter(F.col("_failed").isNull() | (F.col("t.strict") < F.col("_failed")))
            .groupBy("_stratum", F.col("t.measure").alias("measure"))
            .agg(F.max_by("t.cutoff", "t.strict").alias("cutoff")))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", risk: float = RISK,
           delta: float = DELTA) -> DataFrame:
    """Id, stratum, measures, base_failed and kept of every row.

    Texts are read once: their measures, a few numbers a row, are written to the shared folder, and
    thresholds and verdicts are worked out on these.
    """
    ready(docs.sparkSession)
    rows = written(measured(docs).select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("_in"), *COUNTS), "quality")
    cut = cutoffs(rows, labels, "_in", risk, delta)
    wide = cut.groupBy("_stratum").pivot("measure", list(GRID)).agg(F.first("cutoff"))
    wide = wide.select(F.col("_stratum"), *[F.col(m).alias(f"_cut_{m}") for m in GRID])
    df = rows.join(wide, F.col("_in").eqNullSafe(F.col("_stratum")), "left")
    bad = F.lit(False)
    for name, (sign, _) in GRID.items():
        m = MEASURES[name]()
        c = F.col(f"_cut_{name}")
        bad = bad | F.coalesce((m > c) if sign > 0 else (m < c), F.lit(False))
    return df.select(F.col("doc_id").alias(id_col), F.col("_in").alias(stratum), *COUNTS,
                     base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                       "n_repeat_words", "base_failed", "kept")
