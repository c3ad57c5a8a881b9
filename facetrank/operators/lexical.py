"""BM25 (Okapi) retrieval per aspect.

Statistics are per aspect: N, average length and document frequency count only
the chunks of that aspect.  Tokens are whitespace tokens, case kept.  A
negative idf is replaced by ``epsilon * mean idf`` of the aspect's vocabulary.

Plan shape
----------
* document frequencies need the whole vocabulary (its mean idf replaces negative ones): each chunk's distinct tokens,
  pre-aggregated in the map task.
* scoring: no row per (query, chunk) is ever shuffled.  Chunks are dealt to blocks by id, as many as their bytes ask for, and
  the batch's terms with their weights are copied to the blocks of their aspect.  A task multiplies term impacts of a
  block's chunks by the queries' weights and emits n rows a query; a ``row_number() <= n`` window finishes.
* padding: the top-n always has ``min(n, chunks in aspect)`` rows because
  unscored chunks score 0.  Candidates are the scored chunks plus the first n
  chunks of the aspect by id (a ``row_number() <= n`` window, planned with a
  partial group limit).  When an aspect's mean idf is negative, scored chunks
  can fall below 0; then all chunks of a block, not only the scored ones, are ranked in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BM25_B, BM25_EPSILON, BM25_K1, RETRIEVAL_TOP_N

RANK_DIGITS = 9  # scores are ranked on this many decimals, then by id
BLOCK_BYTES = 64 << 20   # text of a block of chunks (all aspects)
QUERY_ROWS = 2048        # queries of a block
QUERY_SLICE = 256        # queries scored at once
CELLS = 4_000_000        # chunks x terms held at once


def tokens(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def postings(chunks: DataFrame) -> DataFrame:
    """aspect, doc_id, dl, term, tf.  A chunk without tokens keeps one row with a null term."""
    toks = chunks.select("aspect", "doc_id", tokens("text").alias("toks"))
    return (toks.select("aspect", "doc_id", F.size("toks").alias("dl"),
                        F.explode_outer("toks").alias("term"))
            .groupBy("aspect", "doc_id", "dl", "term")
            .agg(F.count(F.lit(1)).alias("tf")))


@dataclass
class Bm25Index:
    """Postings and statistics, built once and read by every query of a batch."""
    postings: DataFrame   # aspect, doc_id, dl, term (null for an empty chunk), tf
    docs: DataFrame       # aspect, doc_id, dl
    aspects: DataFrame    # aspect, n_docs, avgdl, mean_idf, eps
    terms: DataFrame      # aspect, term, df, idf


def build_index(chunks: DataFrame, epsilon: float = BM25_EPSILON, materialize: str | bool = "persist",
                queries: DataFrame | None = None) -> Bm25Index:
    """Postings and statistics of the chunks.

    queries: a batch the index is for; only postings of its terms are then made, and whole-corpus work is left to
    the document frequencies, which are counted once a chunk and pre-aggregated before their shuffle.
    materialize: "persist" keeps the postings in executor memory/disk for the
    branches of one query batch (lost blocks are recomputed from the lineage);
    "checkpoint" writes them to the shared folder (``spark.checkpoint.dir``),
    cutting the lineage, for an index that outlives the batch; False plans inline.
    Nothing runs before a result is asked for, but for "checkpoint".
    """
    toks = chunks.select("aspect", "doc_id", tokens("text").alias("toks"))
    post = postings(chunks) if queries is None else (
        toks.select("aspect", "doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
        .join(query_terms(queries).select("term").distinct(), "term", "left_semi")
        .groupBy("aspect", "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    if materialize == "checkpoint":
        post = post.checkpoint(eager=True)
    elif materialize:
        post = post.persist(StorageLevel.MEMORY_AND_DISK)
    docs = toks.select("aspect", "doc_id", F.size("toks").alias("dl"))
    asp = docs.groupBy("aspect").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df_ = (toks.select("aspect", F.explode(F.array_distinct("toks")).alias("term"))
           .groupBy("aspect", "term").agg(F.count(F.lit(1)).alias("df")))
    raw = (df_.join(asp.select("aspect", "n_docs"), "aspect")
           .withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    if materialize:
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)     # read for the mean and for the terms
    mean = raw.groupBy("aspect").agg(F.avg("raw_idf").alias("mean_idf"))
    aspects = (asp.join(mean, "aspect", "left").withColumn("eps", F.lit(epsilon) * F.col("mean_idf")))
    if materialize:
        aspects = aspects.persist(StorageLevel.MEMORY_AND_DISK)
    terms = (raw.join(aspects.select("aspect", "eps"), "aspect")
             .select("aspect", "term", "df",
                     F.when(F.col("raw_idf") < 0, F.col("eps")).otherwise(F.col("raw_idf")).alias("idf")))
    return Bm25Index(post, docs, aspects, terms)


def term_stats(chunks: DataFrame, index: Bm25Index | None = None,
               epsilon: float = BM25_EPSILON) -> tuple[DataFrame, DataFrame]:
    """Return (terms: aspect, term, df, idf; aspects: aspect, n_docs, avgdl, mean_idf, eps)."""
    index = index or build_index(chunks, epsilon, materialize=False)
    return index.terms, index.aspects


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf (repeated query tokens count repeatedly)."""
    return (queries.select("query_id", F.explode(tokens("query")).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def all_aspects(queries: DataFrame, aspects: list[str]) -> DataFrame:
    """Every query against every aspect of a fixed aspect list."""
    return queries.select("query_id", F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"))


def wanted_terms(terms: DataFrame, aspects: DataFrame, queries: DataFrame, query_aspects: DataFrame) -> DataFrame:
    """query_id, aspect, term, qtf, idf, avgdl, eps: the batch's terms in the aspects asked for."""
    return (query_terms(queries).join(query_aspects.select("query_id", "aspect"), "query_id")
            .join(terms.select("aspect", "term", "idf"), ["aspect", "term"])
            .join(aspects.select("aspect", "avgdl", "eps"), "aspect")
            .select("query_id", "aspect", "term", "qtf", "idf", "avgdl", "eps"))


Counts = Callable[[pa.Table, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def text_counts(rows: pa.Table, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of ``text`` that are in the vocabulary: row, term, times (1 each); and the number of tokens of each row."""
    split = pc.ascii_split_whitespace(rows.column("text").combine_chunks().fill_null(""))
    flat, row = split.flatten(), np.repeat(np.arange(len(split)), np.diff(np.asarray(split.offsets)))
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    term = np.asarray(pc.index_in(flat, value_set=vocabulary).fill_null(-1))
    length = np.bincount(row[some], minlength=rows.num_rows)
    known = some & (term >= 0)
    return row[known], term[known], np.ones(int(known.sum())), length


def list_counts(rows: pa.Table, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same from ``terms``, ``tfs`` and ``dl``."""
    lists, times = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))
    term = np.asarray(pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1))
    known = term >= 0
    return (row[known], term[known], np.asarray(times.flatten())[known].astype(float),
            np.asarray(rows.column("dl").combine_chunks().fill_null(0)))


def _best(left: pa.Table, right: pa.Table, counts: Counts, merged: bool, n: int, k1: float, b: float) -> list[tuple]:
    """The first n chunks of the block for each query: positions in left and right, scores."""
    asked = left.column("asked").combine_chunks()
    flat = asked.flatten()
    vocabulary = pc.unique(flat.field("term"))
    weight = np.zeros((left.num_rows, len(vocabulary)))
    of = np.repeat(np.arange(left.num_rows), np.asarray(pc.list_value_length(asked)))
    np.add.at(weight, (of, np.asarray(pc.index_in(flat.field("term"), value_set=vocabulary))), np.asarray(flat.field("weight")))
    asks = np.zeros(weight.shape)
    asks[of, np.asarray(pc.index_in(flat.field("term"), value_set=vocabulary))] = 1.0
    avgdl, whole = left.column("avgdl")[0].as_py(), left.column("whole")[0].as_py()

    # chunks in the order of their ids, which breaks ties; equal ids are one chunk if merged
    ids = right.column("doc_id").combine_chunks()
    known = pc.unique(ids)
    known = known.take(pc.sort_indices(known, null_placement="at_start"))
    code = np.asarray(pc.index_in(ids, value_set=known)).astype(np.int64)
    row, term, times, length = counts(right, vocabulary)
    same = np.unique(np.stack([code, length], 1), axis=0, return_inverse=True)[1].reshape(-1) if merged else \
        np.argsort(np.argsort(code, kind="stable"), kind="stable")
    first = np.zeros(same.max(initial=-1) + 1, np.int64)     # a row of each (chunk, length), then its chunk
    first[same[::-1]] = np.arange(len(same))[::-1]
    chunk = code[first] if merged else np.arange(len(first))
    rows = np.zeros(chunk.max(initial=-1) + 1, np.int64)
    rows[chunk[::-1]] = first[::-1]
    key, at = np.unique(same[row] * max(1, len(vocabulary)) + term, return_inverse=True)
    tf = np.bincount(at.reshape(-1), weights=times, minlength=len(key))
    own, term = key // max(1, len(vocabulary)), key % max(1, len(vocabulary))
    impact = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length[first[own]] / avgdl)) if len(key) else tf
    own = chunk[own]

    out, size, step = [], len(rows), max(16, CELLS // max(1, len(vocabulary)))
    for s in range(0, left.num_rows, QUERY_SLICE):
        w, some = weight[s:s + QUERY_SLICE], asks[s:s + QUERY_SLICE]
        signs = bool(((w <= 0) & (some > 0)).any())          # only then can a chunk with a term score 0
        score, hit = np.zeros((len(w), size)), np.zeros((len(w), size), bool)
        for c in range(0, size, step):
            lo, hi = np.searchsorted(own, [c, c + step])
            impacts = np.zeros((min(step, size - c), len(vocabulary)))
            np.add.at(impacts, (own[lo:hi] - c, term[lo:hi]), impact[lo:hi])
            score[:, c:c + step] = w @ impacts.T
            hit[:, c:c + step] = (some @ (impacts > 0).T.astype(float) > 0) if signs else score[:, c:c + step] > 0
        by = np.round(score, RANK_DIGITS)
        if not whole:
            by[~hit] = -np.inf
        keep = min(n, size)
        least = np.partition(by, size - keep, axis=1)[:, size - keep]
        q, d = np.nonzero((by >= least[:, None]) & (by > -np.inf))
        order = np.lexsort((d, -by[q, d], q))
        q, d = q[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, d = q[place < n], d[place < n]
        out.append((q + s, rows[d], score[q, d]))
    return out


def best_in_blocks(rows: DataFrame, blocks: Column, counts: Counts, merged: bool, wanted: DataFrame, aspects: DataFrame,
                   query_aspects: DataFrame, n: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """query_id, aspect, doc_id, score: the first n of every block of chunks among those that share a term with the query,
    or among all of them where the aspect's eps is negative.

    rows: aspect, doc_id and what ``counts`` reads.  blocks: the number of blocks, a scalar.  merged: rows of one id are one
    chunk, whose tokens count together where the lengths are equal.
    """
    pair = ["query_id", "aspect"]
    weights = wanted.groupBy(*pair).agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("asked"))
    parts = F.greatest(F.lit(1), F.ceil(query_aspects.agg(F.count_distinct("query_id")).scalar() / QUERY_ROWS)).cast("int")
    none = F.array().cast("array<struct<term:string,weight:double>>")
    left = (query_aspects.select(*pair).distinct()
            .join(aspects.select("aspect", "avgdl", F.coalesce(F.col("eps") < 0, F.lit(False)).alias("whole")), "aspect")
            .join(weights, pair, "left").where(F.col("asked").isNotNull() | F.col("whole"))
            .select(*pair, "avgdl", "whole", F.coalesce("asked", none).alias("asked"))
            .withColumn("qb", F.pmod(F.xxhash64("query_id"), parts).cast("int"))
            .withColumn("cb", F.explode(F.sequence(F.lit(0), blocks - 1))))
    # both sides may come from the same table: columns of their own
    right = (rows.where(F.col("aspect").isNotNull()).select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("cb", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), parts - 1))))
    kinds = dict(rows.dtypes) | dict(query_aspects.dtypes)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best(left, right, counts, merged, n, k1, b) if left.num_rows and right.num_rows else []
        q, d, score = (np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in range(3))
        q, d = pa.array(q.astype(np.int64)), pa.array(d.astype(np.int64))
        return pa.table([left.column("query_id").take(q), left.column("aspect").take(q), right.column("doc_id").take(d),
                         pa.array(score.astype(float))], names=["query_id", "aspect", "doc_id", "score"])

    keys = ["aspect", "cb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        best, f"query_id {kinds['query_id']}, aspect string, doc_id {kinds['doc_id']}, score double")


def block_count(df: DataFrame, size: Column, most: int, per: int = 4) -> Column:
    """How many blocks keep sum(size) of each below ``most``; a ``per``-th of the shuffle partitions at least.  A scalar."""
    least = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // per)
    return F.greatest(F.lit(least), F.ceil(F.coalesce(df.agg(F.sum(size)).scalar(), F.lit(0)) / most)).cast("int")


def bm25_topk(chunks: DataFrame, queries: DataFrame, query_aspects: DataFrame,
              n: int = RETRIEVAL_TOP_N, k1: float = BM25_K1, b: float = BM25_B,
              epsilon: float = BM25_EPSILON, index: Bm25Index | None = None) -> DataFrame:
    """Top-n per (query, aspect), zero-score chunks included: query_id, aspect, doc_id, score, rank."""
    index = index or build_index(chunks, epsilon, queries=queries)
    wanted = wanted_terms(index.terms, index.aspects, queries, query_aspects)
    rows = chunks.select("aspect", "doc_id", "text")
    blocks = block_count(chunks, F.octet_length("text") + 64, BLOCK_BYTES)
    scores = best_in_blocks(rows, blocks, text_counts, True, wanted, index.aspects, query_aspects, n, k1, b)
    return padded(scores, index.docs.select("aspect", "doc_id"), index.aspects, query_aspects, n)


def padded(scores: DataFrame, ids: DataFrame, aspects: DataFrame, query_aspects: DataFrame, n: int) -> DataFrame:
    """The top n of scored chunks and of chunks that score 0 (``ids``: aspect, doc_id of every chunk).  In aspects of
    negative eps ``scores`` has the chunks that score 0, too."""
    first_n = (ids.withColumn("_rn", F.row_number().over(Window.partitionBy("aspect").orderBy("doc_id")))
               .where(F.col("_rn") <= n).drop("_rn"))
    neg = aspects.where(F.col("eps") < 0).select("aspect")
    pad = first_n.join(neg, "aspect", "left_anti").distinct()
    qa = query_aspects.select("query_id", "aspect")
    pad_q = qa.join(pad, "aspect")
    cand = (scores.join(pad_q, ["query_id", "aspect", "doc_id"], "full_outer")
            .select("query_id", "aspect", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score")))
    return rank_within(cand, ["query_id", "aspect"], "score", "doc_id", n)


def rank_within(df: DataFrame, keys: list[str], score: str, tie: str, n: int | None,
                rank_col: str = "rank") -> DataFrame:
    """1-based rank by score (rounded to RANK_DIGITS) descending, ties by id ascending."""
    w = Window.partitionBy(*keys).orderBy(F.round(score, RANK_DIGITS).desc(), F.col(tie).asc())
    out = df.withColumn("_rn", F.row_number().over(w))
    if n is not None:
        out = out.where(F.col("_rn") <= n)  # filter on the window output: planned as a partial group limit
    return out.withColumn(rank_col, F.col("_rn").cast("long")).drop("_rn")
