"""Article fields from raw HTML pages, as column expressions over a pages table.

title    first ``<h1>`` (tags removed, whitespace collapsed), default '제목없음'
date     first ``<time>`` element, default 'null'
author   element with class ``nickname``, default 'null'
content  the ``<article>`` body without its heading: tags become blanks,
         entities are decoded, whitespace is collapsed; default when absent
Pages without an ``<article>`` box are dropped by ``keep_articles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapse_ws, html_decode, strip_tags


def _field(html: Column, pattern: str, default: str) -> Column:
    raw = F.regexp_extract(html, pattern, 1)
    val = collapse_ws(html_decode(strip_tags(raw)))
    return F.when(F.regexp_like(html, F.lit(pattern)) & (val != ""), val).otherwise(F.lit(default))


def has_article(html: Column | str) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.coalesce(F.contains(h, F.lit("<article")), F.lit(False))


def extract_articles(pages: DataFrame) -> DataFrame:
    """page_id, title, author, date, url, content."""
    h = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_extract(h, r"(?s)<article[^>]*>(.*?)</article>", 1)
    body = F.regexp_replace(body, r"(?s)<h1[^>]*>.*?</h1>", " ")
    content = collapse_ws(html_decode(strip_tags(body)))
    return pages.select(
        "page_id",
        _field(h, r"(?s)<h1[^>]*>(.*?)</h1>", fixed.DEFAULT_TITLE).alias("title"),
        _field(h, r"(?s)class=\"nickname\"[^>]*>(.*?)<", fixed.DEFAULT_AUTHOR).alias("author"),
        _field(h, r"(?s)<time[^>]*>(.*?)</time>", fixed.DEFAULT_DATE).alias("date"),
        "url",
        F.when(has_article(h) & (content != ""), content).otherwise(F.lit(fixed.DEFAULT_CONTENT)).alias("content"),
    )


def keep_articles(pages: DataFrame) -> DataFrame:
    return pages.where(has_article("html"))


def absolute_links(pages: DataFrame, base: str = fixed.LINK_BASE) -> DataFrame:
    """page_id, pos, href, url: every href, prefixed with ``base`` unless it holds 'https'."""
    hrefs = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r'href="([^"]*)"'), 1)
    return (pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))
            .withColumn("pos", F.col("pos").cast("long"))
            .withColumn("url", F.when(F.contains(F.col("href"), F.lit("https")), F.col("href"))
                        .otherwise(F.concat(F.lit(base), F.col("href")))))
