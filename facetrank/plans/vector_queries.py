"""Registered queries for vector operators: encode, pool, normalise, cosine, dot, LSH."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import RETRIEVAL_TOP_N
from ..functions.vectors import cosine, dot, l2_normalize
from ..operators import ann, dense, encode
from ..sources import fixtures as fx
from .oracle import CHUNKS, CVEC_TEXT, QVEC, dense_ranked
from .oracle import cosine as sql_cos

DIMS = 64


def q_encode_texts(spark, sf):
    """Sparse view of the encoded chunk vectors: doc_id, dim, value (non-zero dims)."""
    v = encode.encode_texts(fx.chunks(spark, sf), "text", "doc_id", lambda: encode.HashedTokenEncoder(DIMS))
    return (v.select("doc_id", F.posexplode("vector").alias("dim", "value"))
            .where(F.col("value") != 0).select("doc_id", "dim", F.round("value", 6).alias("value")))


SQL_ENCODE = f"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS tok FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIMS} AS INTEGER) AS dim, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM b GROUP BY doc_id)
SELECT b.doc_id, b.dim, round(b.c / greatest(n.norm, 1e-12), 6) AS value FROM b JOIN n USING (doc_id)"""


def q_encode_pooled(spark, sf):
    """Sparse view of the pooled token vectors of all chunks: doc_id, dim, value (non-zero dims)."""
    v = encode.encode_pooled(fx.chunks(spark, sf))
    return (v.select("doc_id", F.posexplode("vector").alias("dim", "value"))
            .where(F.col("value") != 0).select("doc_id", "dim", F.round("value", 6).alias("value")))


SQL_ENCODE_POOLED = f"""WITH {CHUNKS},{CVEC_TEXT},
x AS (SELECT doc_id, unnest(range({DIMS})) AS dim, unnest(v) AS c, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS norm FROM cvec)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(c / norm, 6) AS value FROM x WHERE c <> 0"""


def q_mean_pool(spark, sf):
    """Mean vector of a label under a mask: rows whose first component is negative are masked."""
    v = fx.vectors(spark, sf).withColumnRenamed("aspect", "label").withColumn("mask", F.when(F.get("vector", F.lit(0)) < 0, 0).otherwise(1))
    return encode.mean_pool(v, "label", mask="mask").select("label", "pos", F.round("value", 6).alias("value"))


SQL_POOL = """WITH x AS (SELECT CAST(label AS VARCHAR) AS label, CASE WHEN embedding[1] < 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m,
                         unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)
SELECT label, pos, round(sum(CAST(v AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS value FROM x GROUP BY label, pos"""


def q_l2_normalize(spark, sf):
    v = fx.vectors(spark, sf)
    return v.select("doc_id", F.transform(l2_normalize("vector"), lambda x: F.round(x, 6)).alias("vector"))


SQL_L2 = """WITH e AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT doc_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6)) AS vector FROM e"""


def _next_pairs(spark, sf):
    v = fx.vectors(spark, sf)
    a = v.select("doc_id", F.col("vector").alias("a"))
    b = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("b"))
    return a.join(b, "doc_id")


def q_cosine_pairs(spark, sf):
    return _next_pairs(spark, sf).select("doc_id", F.round(cosine("a", "b"), 6).alias("cos"))


SQL_COS = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS doc_id, round({sql_cos('a.v', 'b.v')}, 6) AS cos FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"""


def q_dot_pairs(spark, sf):
    return _next_pairs(spark, sf).select("doc_id", F.round(dot("a", "b"), 6).alias("dot"))


SQL_DOT = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"""


def q_dense_topk_lsh(spark, sf):
    return dense.dense_topk_lsh(fx.vectors(spark, sf), fx.query_vectors(spark, sf)).select(
        "query_id", "aspect", "doc_id", F.round("sim", 6).alias("sim"), "rank")


def q_dense_topk_ivf(spark, sf):
    return ann.dense_topk_ivf(fx.vectors(spark, sf), fx.query_vectors(spark, sf)).select(
        "query_id", "aspect", "doc_id", F.round("sim", 6).alias("sim"), "rank")


def _bucket_sql(v: str, plane_rows: list[list[float]]) -> str:
    lists = [f"[{', '.join(f'{x:.0f}' for x in p)}]::DOUBLE[]" for p in plane_rows]
    return " + ".join(f"(CASE WHEN list_dot_product({v}, {p}) >= 0 THEN {2 ** b} ELSE 0 END)" for b, p in enumerate(lists))


def _lsh_sql() -> str:
    planes = dense.sign_planes(dense.LSH_DIM, dense.LSH_TABLES, dense.LSH_BITS)
    keyed = lambda cte, key: " UNION ALL ".join(
        f"SELECT {key}, {t} AS t, {_bucket_sql('v', p)} AS bucket FROM {cte}" for t, p in enumerate(planes))
    return f"""WITH q AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS v
           FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
c AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS aspect, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qk AS ({keyed('q', 'query_id')}), ck AS ({keyed('c', 'doc_id')}),
p AS (SELECT DISTINCT query_id, doc_id FROM qk JOIN ck USING (t, bucket)),
s AS (SELECT p.query_id, c.aspect, p.doc_id, {sql_cos('q.v', 'c.v')} AS sim
      FROM p JOIN q USING (query_id) JOIN c USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, aspect ORDER BY round(sim, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, aspect, doc_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= {RETRIEVAL_TOP_N}"""


SQL_LSH = _lsh_sql()

# the index skips cells, not results: the SQL compares every pair
SQL_IVF = f"""WITH queries AS (SELECT item_id AS query_id FROM benchmark),{QVEC},
corp AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS aspect, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{dense_ranked('corp', None)[1:]}
SELECT query_id, aspect, doc_id, round(sim, 6) AS sim, rank FROM dense"""

REGISTRY = {
    "encode_texts": (q_encode_texts, SQL_ENCODE),
    "encode_pooled": (q_encode_pooled, SQL_ENCODE_POOLED),
    "mean_pool": (q_mean_pool, SQL_POOL),
    "l2_normalize": (q_l2_normalize, SQL_L2),
    "cosine_pairs": (q_cosine_pairs, SQL_COS),
    "dot_pairs": (q_dot_pairs, SQL_DOT),
    "dense_topk_lsh": (q_dense_topk_lsh, SQL_LSH),
    "dense_topk_ivf": (q_dense_topk_ivf, SQL_IVF),
}
