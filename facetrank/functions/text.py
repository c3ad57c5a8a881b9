"""Text column expressions: cleaning, audits, inline tags, numbers, keywords.

Every function returns a Column built from Spark built-ins, so it runs inside
whole-stage codegen over whole texts.  Whitespace is the ASCII class ``\\s``
(the same in Java regex and RE2); ``strip`` removes leading and trailing
whitespace, unlike ``trim``, which removes blanks only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def collapse_ws(x: Column | str) -> Column:
    return strip(F.regexp_replace(_c(x), r"\s+", " "))


def remove_literal(x: Column | str, literal: str) -> Column:
    """Literal removal (no regex) followed by strip."""
    return strip(F.replace(_c(x), F.lit(literal), F.lit("")))


def contains_or_false(x: Column | str, literal: str) -> Column:
    return F.coalesce(F.contains(_c(x), F.lit(literal)), F.lit(False))


def missing_items(x: Column | str, items: list[str]) -> Column:
    """Items of ``items`` (in order) that the text does not contain; null text counts as 'None'."""
    t = F.coalesce(_c(x), F.lit("None"))
    return F.filter(F.array(*[F.lit(i) for i in items]), lambda w: ~F.contains(t, w))


def tag_value(x: Column | str, tag: str, absent: str = fixed.ABSENT_TAG) -> Column:
    """Text after ``<tag>`` up to the next '<' or the end, stripped; ``absent`` if no tag."""
    t = F.coalesce(_c(x), F.lit("nan"))
    mark = f"<{tag}>"
    return F.when(F.contains(t, F.lit(mark)),
                  strip(F.regexp_extract(t, f"<{tag}>([^<]*)", 1))).otherwise(F.lit(absent))


def digits_only(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("nan")), "[^0-9]", "")


def digits_to_int(x: Column | str) -> Column:
    """Every digit kept and joined ('200~250' -> 200250); no digit -> 0."""
    d = digits_only(x)
    return F.when(d == "", F.lit(0).cast("long")).otherwise(d.try_cast("long"))


def digits_or_null(x: Column | str) -> Column:
    """Same, but null (the reference's 'None') when the text has no digit."""
    d = digits_only(x)
    return F.when(d == "", F.lit(None).cast("long")).otherwise(d.try_cast("long"))


def any_keyword(x: Column | str, words: list[str]) -> Column:
    t = F.coalesce(_c(x).cast("string"), F.lit("nan"))
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(t, F.lit(w))
    return cond


def region_of(name: Column | str) -> Column:
    """First region whose keyword occurs in the name, else the default."""
    expr = None
    for region, words in fixed.REGION_KEYWORDS:
        cond = any_keyword(name, words)
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return expr.otherwise(F.lit(fixed.REGION_DEFAULT))


def vibe_flags(text: Column | str) -> list[Column]:
    return [any_keyword(text, words).cast("int").alias(flag) for flag, words in fixed.VIBE_FLAGS]


def negation_factor(text: Column | str) -> Column:
    return F.when(any_keyword(text, fixed.NEGATIVE_SIGNALS), F.lit(fixed.NEGATION_FACTOR)).otherwise(F.lit(1.0))


def words(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), 0)


def first_price(text: Column | str, pattern: str, default: int, unit: int = 1) -> Column:
    m = F.regexp_extract(F.coalesce(_c(text), F.lit("")), pattern, 1)
    v = F.replace(m, F.lit(","), F.lit("")).try_cast("long") * F.lit(unit)
    return F.when(m == "", F.lit(default).cast("long")).otherwise(F.coalesce(v, F.lit(default).cast("long")))


def keyword_sentences(text: Column | str, keywords: list[str]) -> Column:
    """Sentences (up to and including a '.') holding a keyword, joined by a blank.

    Same result as ``findall('[^.]*(?:k1|k2)[^.]*\\.')``: every match starts right
    after the previous '.', so it is a whole '.'-terminated segment.  Written as
    split + filter because the backtracking pattern is quadratic in Java on long texts.
    """
    parts = F.split(F.coalesce(_c(text), F.lit("")), r"\.")
    closed = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hits = F.filter(closed, lambda s: any_keyword(s, keywords))
    return F.array_join(F.transform(hits, lambda s: F.concat(s, F.lit("."))), " ")


def first_word(text: Column | str) -> Column:
    return F.split_part(F.coalesce(_c(text), F.lit("")), F.lit(" "), F.lit(1))


def compose_query(tags: Column | str, raw: Column | str) -> Column:
    return F.concat_ws(" ", F.array_join(F.coalesce(_c(tags), F.array().cast("array<string>")), " "),
                       F.coalesce(_c(raw), F.lit("")))


def html_decode(x: Column) -> Column:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "<[^>]+>", " ")
