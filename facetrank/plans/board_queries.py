"""Registered queries over board pages that are made from the given tables, so that SQL knows what they hold.

Articles: a page for every document.  The text's lines become paragraphs in nested elements, with named and numeric entities;
a document without a language has no date element, one without a source no author, one whose text is blank no box.
Listings: a page for every source with a row for every document; short documents are notices, without a number.
Counts: rows of each stage of the two-stage flow, by ``Observation``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import rerank
from ..sources import board
from ..sources import fixtures as fx
from . import observed, oracle
from . import two_stage as ts
from .sqlx import lit

NOTICE = 1_000       # characters of a document that is a notice


def _escaped(x: Column) -> Column:
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("e", "&#x65;"), ("é", "&eacute;")):
        x = F.replace(x, F.lit(ch), F.lit(ent))
    return x


def article_pages(spark, sf) -> DataFrame:
    """page_id, html."""
    d = fx.table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<div><p>"), _escaped(x), F.lit("</p><br></div>")))
    date = F.when(F.col("n_chars") > 400, F.concat(F.lit('<span class="d date">'), _escaped(F.col("lang")), F.lit(" &middot; "),
                                                   F.col("n_chars").cast("string"), F.lit("</span>")))
    author = F.when(F.col("n_chars") <= 3000, F.concat(F.lit('<button type="button" class="nickname">\n '), _escaped(F.col("source")), F.lit("</button>")))
    box = F.concat(
        F.lit('<div class="ArticleContentBox"><div class="head"><h3 class="title_text">No '), F.col("doc_id").cast("string"),
        F.lit(" <b>&num;1</b></h3>"), F.coalesce(author, F.lit("")), F.coalesce(date, F.lit("")),
        F.lit('</div><div class="se-main-container"><script>var p = "</p>";</script><div class="in"><!-- <p>no</p> -->'),
        F.array_join(lines, "\n"), F.lit('</div></div><div class="tail">after</div></div><h3 class="title_text">other</h3>'))
    html = F.concat(F.lit("<html><body><p>before"), F.when(F.trim(text) == "", F.lit("")).otherwise(box), F.lit("</body></html>"))
    return d.select(F.col("doc_id").alias("page_id"), html.alias("html"))


def q_board_articles(spark, sf):
    return board.board_articles(article_pages(spark, sf))


SQL_BOARD_ARTICLES = f"""SELECT doc_id AS page_id, 'No ' || CAST(doc_id AS VARCHAR) || ' #1' AS title,
       CASE WHEN n_chars <= 3000 THEN source ELSE {lit(fixed.DEFAULT_AUTHOR)} END AS author,
       CASE WHEN n_chars > 400 THEN lang || ' · ' || CAST(n_chars AS VARCHAR) ELSE {lit(fixed.DEFAULT_DATE)} END AS date,
       trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS content
FROM documents WHERE trim(coalesce(text, '')) <> ''"""


def listing_pages(spark, sf) -> DataFrame:
    """page_id (the venue), html."""
    d = fx.chunks(spark, sf).join(fx.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    number = F.when(F.col("n_chars") >= NOTICE, F.concat(F.lit('<div class="board-number"><div class="inner_number"> '),
                                                         F.col("doc_id").cast("string"), F.lit("</div></div>"))).otherwise(
        F.lit('<strong class="board-tag-txt">notice</strong>'))
    href = F.when(F.col("aspect") == "en", F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("/a?b=1&amp;c="), F.col("doc_id").cast("string")))
    row = F.concat(F.lit('<tr><td class="td_article">'), number, F.lit('<div class="board-list"><a class="article" href="'), href,
                   F.lit('">t</a></div><td class="td_date">1</tr>'))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", row.alias("row")))), lambda x: x["row"]), "")
    rows = d.groupBy(F.col("venue_id").alias("page_id")).agg(body.alias("body"))
    return rows.select("page_id", F.concat(
        F.lit('<table><tr><td class="td_article"><i class="inner_number">0</i><a class="article" href="no">x</a></td></tr></table>'
              '<div class="article-board m-tcol-c"><table><tbody>'), F.col("body"), F.lit("</tbody></table></div>")).alias("html"))


def q_board_rows(spark, sf):
    return board.board_rows(listing_pages(spark, sf))


SQL_BOARD_ROWS = f"""SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS page_id,
       row_number() OVER (PARTITION BY regexp_extract(source, '(\\d+)$', 1) ORDER BY doc_id) - 1 AS pos, CAST(doc_id AS VARCHAR) AS number,
       CASE WHEN lang = 'en' THEN 'https://x/' || CAST(doc_id AS VARCHAR)
            ELSE {lit(fixed.LINK_BASE)} || '/a?b=1&c=' || CAST(doc_id AS VARCHAR) END AS url
FROM documents WHERE n_chars >= {NOTICE}"""


def q_stage_counts(spark, sf):
    """Rows of each stage of the two-stage flow; the seconds are left out, they differ from run to run."""
    return observed.run(ts.Inputs.from_sf(spark, sf)).report.select("position", "stage", "n_rows")


SQL_STAGE_COUNTS = f"""{oracle.PIPE}
SELECT CAST(1 AS BIGINT) AS position, 'intent' AS stage, count(*) AS n_rows FROM kept
UNION ALL SELECT 2, 'candidates', count(*) FROM cand UNION ALL SELECT 3, 'reranked', count(*) FROM rr
UNION ALL SELECT 4, 'venues', count(*) FROM soft UNION ALL SELECT 5, 'top', count(*) FROM top"""


def length_intent(queries, aspects):
    """A custom intent scorer: an aspect's share of a query is its place in the list over the query's length."""
    import numpy as np
    return np.array([[(k + 1) * 20 / max(1, len(q)) for k in range(len(aspects))] for q in queries]).reshape(len(queries), len(aspects))


def q_rerank_custom(spark, sf):
    """The flow with custom intent and pair scorers."""
    r = ts.run(ts.Inputs.from_sf(spark, sf), scorer=rerank.jaccard_scorer, intent_scorer=length_intent)
    return r.reranked.select("query_id", "aspect", "doc_id", F.round("cross_score", 6).alias("cross_score"), "rerank_pos")


_ASPECTS = ", ".join(f"({lit(a)}, {k + 1})" for k, a in enumerate(fx.DOCUMENT_ASPECTS))
_CUSTOM_KEPT = f"""kept AS (SELECT query_id, a.aspect, a.k * 20.0::DOUBLE / greatest(1, length(query)) AS score
         FROM queries, (VALUES {_ASPECTS}) a(aspect, k) WHERE a.k * 20.0::DOUBLE / greatest(1, length(query)) > {fixed.INTENT_THRESHOLD})"""
SQL_RERANK_CUSTOM = f"""WITH {oracle.CHUNKS},{oracle.BM25_STATS},{_CUSTOM_KEPT},{oracle.QVEC_TEXT},{oracle.CVEC_TEXT},{oracle.fused('kept')},
tk AS (SELECT c.*, list_distinct({oracle.tok('q.query')}) AS a, list_distinct({oracle.tok('c.text')}) AS b
       FROM cand c JOIN queries q ON q.query_id = c.query_id),
x AS (SELECT *, len(list_intersect(a, b)) AS hits FROM tk),
y AS (SELECT *, CASE WHEN len(a) + len(b) - hits > 0 THEN hits::DOUBLE / (len(a) + len(b) - hits) ELSE 0.0 END AS cross_score FROM x)
SELECT query_id, aspect, doc_id, round(cross_score, 6) AS cross_score,
       row_number() OVER (PARTITION BY query_id ORDER BY round(cross_score, 9) DESC, doc_id) AS rerank_pos FROM y"""


REGISTRY = {
    "rerank_custom": (q_rerank_custom, SQL_RERANK_CUSTOM),
    "board_articles": (q_board_articles, SQL_BOARD_ARTICLES),
    "board_rows": (q_board_rows, SQL_BOARD_ROWS),
    "stage_counts": (q_stage_counts, SQL_STAGE_COUNTS),
}
