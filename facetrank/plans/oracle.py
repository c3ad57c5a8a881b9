"""DuckDB oracle SQL for the registered queries.

The SQL is written brute force (full products at the small check scale) so
that it checks the Spark plans' shortcuts: padding, local top-n, broadcast
query blocks, the gold automaton.  Fragments are shared CTE text.
"""

from __future__ import annotations

from ..functions.fixed import (BM25_B, BM25_EPSILON, BM25_K1, FINAL_TOP_N, INTENT_THRESHOLD,
                               METRIC_K, RETRIEVAL_TOP_N, RRF_K, RRF_MISSING_RANK)
from ..operators.encode import DIMS, MAX_TOKENS
from ..sources.fixtures import DOCUMENT_ASPECTS

TOK = "list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def tok(c: str) -> str:
    return TOK.format(c=c)


def _values(items: list[str]) -> str:
    return ", ".join(f"('{a}')" for a in items)


CHUNKS = f"""
chunks AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS venue_id,
                  source AS hall_name, lang AS aspect, coalesce(text, '') AS text FROM documents),
queries AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark),
ctok AS (SELECT aspect, doc_id, {tok('text')} AS toks FROM chunks)"""

BM25_STATS = f"""
astats AS (SELECT aspect, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM ctok GROUP BY aspect),
post AS (SELECT aspect, doc_id, dl, term, count(*) AS tf
         FROM (SELECT aspect, doc_id, len(toks) AS dl, unnest(toks) AS term FROM ctok)
         GROUP BY aspect, doc_id, dl, term),
tdf AS (SELECT aspect, term, count(*) AS df FROM post GROUP BY aspect, term),
raw AS (SELECT t.aspect, t.term, t.df, ln(a.n_docs - t.df + 0.5) - ln(t.df + 0.5) AS raw_idf
        FROM tdf t JOIN astats a USING (aspect)),
mean AS (SELECT aspect, avg(raw_idf) AS mean_idf FROM raw GROUP BY aspect),
idf AS (SELECT r.aspect, r.term, r.df,
               CASE WHEN r.raw_idf < 0 THEN {BM25_EPSILON}::DOUBLE * m.mean_idf ELSE r.raw_idf END AS idf
        FROM raw r JOIN mean m USING (aspect))"""


def bm25_ranked(qa_cte: str, n: int = RETRIEVAL_TOP_N, name: str = "bm25") -> str:
    """CTEs ending in ``{name}`` (query_id, aspect, doc_id, score, rank) for query-aspects ``qa_cte``."""
    k1, b = BM25_K1, BM25_B
    return f"""
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT query_id, unnest({tok('query')}) AS term FROM queries) GROUP BY query_id, term),
sc AS (SELECT qt.query_id, p.aspect, p.doc_id,
              sum(qt.qtf * i.idf * p.tf * {k1 + 1.0}::DOUBLE
                  / (p.tf + {k1}::DOUBLE * ({1.0 - b}::DOUBLE + {b}::DOUBLE * p.dl / a.avgdl))) AS score
       FROM qt JOIN post p ON p.term = qt.term
       JOIN idf i ON i.aspect = p.aspect AND i.term = p.term
       JOIN astats a ON a.aspect = p.aspect
       GROUP BY qt.query_id, p.aspect, p.doc_id),
bm25_all AS (SELECT qa.query_id, c.aspect, c.doc_id, coalesce(sc.score, 0.0) AS score
             FROM {qa_cte} qa JOIN chunks c ON c.aspect = qa.aspect
             LEFT JOIN sc ON sc.query_id = qa.query_id AND sc.aspect = c.aspect AND sc.doc_id = c.doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, aspect
                                    ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25_all)
           WHERE rank <= {n})"""


def cosine(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12)"
            f" * greatest(sqrt(list_dot_product({b}, {b})), 1e-12)))")


def dense_ranked(corpus_cte: str, qa_cte: str | None, n: int = RETRIEVAL_TOP_N, name: str = "dense") -> str:
    """corpus_cte: (doc_id, aspect, v DOUBLE[]); query vectors from qvec (query_id, v)."""
    qa_join = "" if qa_cte is None else f" JOIN {qa_cte} qa ON qa.query_id = q.query_id AND qa.aspect = c.aspect"
    return f"""
dense_all AS (SELECT q.query_id, c.aspect, c.doc_id, {cosine('q.v', 'c.v')} AS sim
              FROM qvec q JOIN {corpus_cte} c ON true{qa_join}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, aspect
                                    ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM dense_all)
           WHERE rank <= {n})"""


QVEC = """
qvec AS (SELECT q.query_id, CAST(e.embedding AS DOUBLE[]) AS v FROM queries q JOIN embeddings e ON e.vec_id = q.query_id)"""



def encoded(name: str, source: str, ids: str, text: str) -> str:
    """CTEs ending in ``name`` (ids, v): token bucket counts of the first 512 tokens, punctuation left out."""
    return f"""
{name}_t AS (SELECT {ids}, list_filter({tok(text)}[1:{MAX_TOKENS}], lambda t: NOT regexp_full_match(t, '[!-/:-@\\[-`{{-~]+')) AS ts FROM {source}),
{name}_b AS (SELECT {ids}, list_transform(ts, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIMS}) AS bs FROM {name}_t),
{name} AS (SELECT {ids}, list_transform(range({DIMS}), lambda d: CAST(len(list_filter(bs, lambda b: b = d)) AS DOUBLE)) AS v FROM {name}_b)"""


QVEC_TEXT = encoded("qvec", "queries", "query_id", "query")
CVEC_TEXT = encoded("cvec", "chunks", "doc_id, aspect", "text")

ALL_QA = f"""
qa_all AS (SELECT q.query_id, v.aspect FROM queries q JOIN (VALUES {_values(DOCUMENT_ASPECTS)}) v(aspect) ON true)"""

INTENT = f"""
qterm AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM queries),
nq AS (SELECT query_id, count(*) AS nq FROM qterm GROUP BY query_id),
vocab AS (SELECT DISTINCT aspect, unnest(toks) AS term FROM ctok),
iscore AS (SELECT qt.query_id, v.aspect, count(*)::DOUBLE / any_value(nq.nq) AS score
           FROM qterm qt JOIN vocab v ON v.term = qt.term JOIN nq ON nq.query_id = qt.query_id
           GROUP BY qt.query_id, v.aspect),
kept AS (SELECT * FROM iscore WHERE score > {INTENT_THRESHOLD} AND aspect IN ({", ".join(f"'{a}'" for a in DOCUMENT_ASPECTS[:7])})),
counts AS (SELECT q.query_id, greatest(coalesce(k.n, 0), 1) AS n_aspects
           FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM kept GROUP BY query_id) k USING (query_id))"""


def fused(qa_cte: str, n: int = RETRIEVAL_TOP_N) -> str:
    return f"""{bm25_ranked(qa_cte, n)},{dense_ranked('cvec', qa_cte, n)},
fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.aspect, s.aspect) AS aspect,
                 coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS d_rank, s.rank AS s_rank,
                 1.0::DOUBLE / ({RRF_K} + coalesce(d.rank, {RRF_MISSING_RANK}))
                 + 1.0::DOUBLE / ({RRF_K} + coalesce(s.rank, {RRF_MISSING_RANK})) AS rrf_score
          FROM dense d FULL OUTER JOIN bm25 s
            ON d.query_id = s.query_id AND d.aspect = s.aspect AND d.doc_id = s.doc_id),
cand AS (SELECT * FROM (SELECT f.*, c.venue_id AS hall_id, c.hall_name, c.text,
                               row_number() OVER (PARTITION BY f.query_id, f.aspect
                                                  ORDER BY round(f.rrf_score, 9) DESC, f.doc_id) AS rrf_rank
                        FROM fused f JOIN chunks c ON c.doc_id = f.doc_id AND c.aspect = f.aspect)
         WHERE rrf_rank <= {n})"""


RERANK = f"""
rr0 AS (SELECT c.*, CASE WHEN len(list_distinct({tok('q.query')})) = 0 THEN 0.0
                         ELSE len(list_intersect(list_distinct({tok('q.query')}), list_distinct({tok('c.text')})))::DOUBLE
                              / len(list_distinct({tok('q.query')})) END AS cross_score
        FROM cand c JOIN queries q ON q.query_id = c.query_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cross_score, 9) DESC, doc_id) AS rerank_pos FROM rr0)"""

ROLLUP = f"""
best AS (SELECT query_id, hall_id, aspect, max(cross_score) AS best FROM rr GROUP BY query_id, hall_id, aspect),
venue AS (SELECT query_id, hall_id, sum(best) AS base_score, count(*) AS n_found FROM best GROUP BY query_id, hall_id),
soft AS (SELECT v.*, v.base_score * (1.0 + v.n_found / c.n_aspects) AS total_score
         FROM venue v JOIN counts c USING (query_id) WHERE c.n_aspects >= 1),
top AS (SELECT * FROM (SELECT query_id, hall_id, total_score,
                              row_number() OVER (PARTITION BY query_id ORDER BY round(total_score, 9) DESC, hall_id) AS rank
                       FROM soft) WHERE rank <= {FINAL_TOP_N})"""

GOLD = """
gold AS (SELECT DISTINCT q.query_id, c.venue_id AS hall_id FROM queries q JOIN chunks c ON contains(c.text, q.query))"""

PIPE = f"WITH {CHUNKS},{BM25_STATS},{INTENT},{QVEC_TEXT},{CVEC_TEXT},{fused('kept')},{RERANK},{ROLLUP},{GOLD}"


def ideal_dcg(g: str, k: int = METRIC_K) -> str:
    return (f"CASE WHEN least({g}, {k}) > 0 THEN list_sum(list_transform(range(1, least({g}, {k}) + 1), "
            f"lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0.0 END")


def core_sql() -> dict[str, str]:
    qa = "qa_all"
    r6 = lambda c: f"round({c}, 6)"
    out = {
        "bm25_stats": f"""WITH {CHUNKS},{BM25_STATS}
SELECT i.aspect, i.term, i.df, round(i.idf, 6) AS idf, a.n_docs, round(a.avgdl, 6) AS avgdl
FROM idf i JOIN astats a USING (aspect)""",
        "bm25_topk": f"""WITH {CHUNKS},{BM25_STATS},{ALL_QA},{bm25_ranked(qa)}
SELECT query_id, aspect, doc_id, round(score, 6) AS score, rank FROM bm25""",
        "dense_topk": f"""WITH {CHUNKS},{QVEC},
vcorp AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS aspect, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{dense_ranked('vcorp', None)[1:]}
SELECT query_id, aspect, doc_id, round(sim, 6) AS sim, rank FROM dense""",
        "rrf": f"""WITH {CHUNKS},{BM25_STATS},{ALL_QA},{QVEC_TEXT},{CVEC_TEXT},{fused(qa)}
SELECT query_id, aspect, doc_id, hall_id, d_rank, s_rank, round(rrf_score, 8) AS rrf_score, rrf_rank FROM cand""",
        "intent_aspects": f"""WITH {CHUNKS},{INTENT}
SELECT k.query_id, k.aspect, round(k.score, 6) AS score, c.n_aspects FROM kept k JOIN counts c USING (query_id)""",
        "hybrid_candidates": f"""WITH {CHUNKS},{BM25_STATS},{INTENT},{QVEC_TEXT},{CVEC_TEXT},{fused('kept')}
SELECT query_id, aspect, doc_id, hall_id, d_rank, s_rank, round(rrf_score, 8) AS rrf_score, rrf_rank FROM cand""",
        "rerank": f"""{PIPE}
SELECT query_id, aspect, doc_id, hall_id, {r6('cross_score')} AS cross_score, rerank_pos FROM rr""",
        "rerank_report": f"""{PIPE}
SELECT query_id, rerank_pos, hall_id, hall_name, aspect, printf('%.4f', round(cross_score, 4)) AS cross_score,
       text FROM rr""",
        "soft_weight_rollup": f"""{PIPE}
SELECT query_id, hall_id, {r6('base_score')} AS base_score, n_found, {r6('total_score')} AS total_score FROM soft""",
        "step_weight_rollup": f"""{PIPE}
SELECT query_id, hall_id, {r6('base_score')} AS base_score, n_found,
       {r6('base_score * CASE WHEN n_found < 2 THEN 0.5 ELSE 1.5 END')} AS total_score FROM venue""",
        "final_report": f"""{PIPE},
names AS (SELECT venue_id AS hall_id, min(hall_name) AS hall_name FROM chunks GROUP BY venue_id)
SELECT t.query_id, t.rank, t.hall_id, coalesce(n.hall_name, 'Unknown') AS hall_name, round(t.total_score, 4) AS total_score
FROM top t LEFT JOIN names n USING (hall_id)""",
        "two_stage_rank": f"""{PIPE}
SELECT t.query_id, t.rank, t.hall_id, round(t.total_score, 6) AS total_score, g.hall_id IS NOT NULL AS is_gold
FROM top t LEFT JOIN gold g USING (query_id, hall_id)""",
        "eval_recall": f"""{PIPE},
found AS (SELECT DISTINCT query_id, hall_id FROM cand),
per AS (SELECT q.query_id, count(g.hall_id) AS n_gold, count(f.hall_id) AS n_found
        FROM queries q LEFT JOIN gold g USING (query_id)
        LEFT JOIN found f ON f.query_id = g.query_id AND f.hall_id = g.hall_id GROUP BY q.query_id)
SELECT query_id, n_gold, n_found, round(CASE WHEN n_gold > 0 THEN n_found / n_gold ELSE 0.0 END, 6) AS recall FROM per""",
        "eval_metrics": f"""{PIPE},
gr AS (SELECT g.query_id, g.hall_id, t.rank FROM gold g LEFT JOIN top t USING (query_id, hall_id)),
per AS (SELECT query_id, count(*) AS n_gold, sum(CASE WHEN rank IS NOT NULL THEN 1.0 / rank ELSE 0.0 END) AS rr_sum,
               min(rank) AS first_rank, max(CASE WHEN rank <= {METRIC_K} THEN 1 ELSE 0 END) AS hit,
               sum(CASE WHEN rank <= {METRIC_K} THEN 1.0 / log2(rank + 1) ELSE 0.0 END) AS dcg
        FROM gr GROUP BY query_id),
m AS (SELECT q.query_id, coalesce(p.n_gold, 0) AS n_gold, p.rr_sum, p.first_rank, p.hit, p.dcg
      FROM queries q LEFT JOIN per p USING (query_id))
SELECT query_id, n_gold,
       round(CASE WHEN n_gold > 0 THEN rr_sum / n_gold ELSE 0.0 END, 6) AS mrr,
       round(CASE WHEN first_rank IS NOT NULL THEN 1.0 / first_rank ELSE 0.0 END, 6) AS mrr_first,
       coalesce(hit, 0)::DOUBLE AS hit_rate,
       round(CASE WHEN {ideal_dcg('n_gold')} > 0 THEN coalesce(dcg, 0.0) / ({ideal_dcg('n_gold')}) ELSE 0.0 END, 6) AS ndcg
FROM m""",
    }
    out["bm25_topk_stored"] = out["bm25_topk"]
    return out


def all_sql() -> dict[str, str]:
    from . import board_queries, score_queries, text_queries, vector_queries
    out = core_sql()
    for reg in (text_queries.REGISTRY, score_queries.REGISTRY, vector_queries.REGISTRY, board_queries.REGISTRY):
        out.update({k: sql for k, (_, sql) in reg.items() if sql is not None})
    return out
