"""A stored BM25 index: postings in impact-ordered blocks with a maximum each, skipped where they cannot matter.

Tables under one folder:
* postings: a row per block of at most BLOCK chunks of a (aspect, term): the largest impact, ids and term counts, in order of
  impact.  A term in more than PART_ROWS chunks is dealt to parts by id first, each ordered by itself, so no task ever
  holds a whole common term.  Partitioned by a hash of the term: a batch opens only its terms' buckets.
* terms (df, idf) and aspects (number, mean length, eps): the statistics of ``lexical``.
* chunks: id, length, terms and counts of every chunk, to score candidates whole.

The impact of a term in a chunk is its part of the score for idf 1: tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)).

Search, per (query, aspect):
1. from the headers of the blocks alone, each block gets its bound qtf * idf * impact and each term its largest bound;
2. the blocks of highest bound, with FIRST x n rows, are read; the n-th best sum of their parts is a score that n chunks reach;
3. terms whose largest bounds add up to less than that cannot bring a chunk in by themselves, and a block of another
   term is skipped if its bound and the largest bounds of all other terms stay below; chunks in the remaining blocks are
   the candidates;
4. candidates are scored whole from the chunk table, block by block as in ``lexical``, and ranked with its zero-score padding.
   A chunk that is a candidate of some query is scored for all: no row per (query, chunk) is made.

The chunk table and the blocks are built from sorted partitions, a stretch of rows at a time.
Nothing that belongs to the first n is lost.  In an aspect with negative idf values nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import BM25_B, BM25_EPSILON, BM25_K1, RETRIEVAL_TOP_N
from ..session import shared_path
from . import lexical

BLOCK = 64
PART_ROWS = 65_536
BUCKETS = 16
FIRST = 4
SLACK = 1e-6          # more than the rounding of a sum of doubles


@dataclass
class StoredIndex:
    postings: DataFrame   # aspect, term, part, block, impact, n, ids, tfs, bucket
    terms: DataFrame      # aspect, term, df, idf
    aspects: DataFrame    # aspect, n_docs, avgdl, eps
    chunks: DataFrame     # aspect, doc_id, dl, terms, tfs


SCHEMAS = {
    "postings": "aspect string, term string, part int, block long, impact double, n int, ids array<bigint>, tfs array<bigint>, bucket int",
    "terms": "aspect string, term string, df long, idf double",
    "aspects": "aspect string, n_docs long, avgdl double, eps double",
    "chunks": "aspect string, doc_id long, dl int, terms array<string>, tfs array<bigint>",
}


def _impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    norm = F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * dl / avgdl)
    return tf * F.lit(BM25_K1 + 1.0) / (tf + norm)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in stretches that hold whole keys, with the number of each row's key from 0."""
    held: list[pa.RecordBatch] = []

    def whole(more: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        new = np.zeros(len(table), bool)
        for k in keys:
            codes = np.asarray(table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices)
            new[1:] |= codes[1:] != codes[:-1]
        number = np.cumsum(new)
        cut = int(np.searchsorted(number, number[-1])) if more else len(table)     # the last key may go on
        if more:
            held.extend(table.slice(cut).to_batches())
        if cut:
            yield table.slice(0, cut), number[:cut]

    rows = checked = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
            if rows >= 2 * checked:                          # a long key is looked at again only once it has doubled
                yield from whole(True)
                rows = checked = sum(x.num_rows for x in held)
    if held:
        yield from whole(False)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """aspect, doc_id, dl with sorted terms and counts, from rows sorted by these; equal keys are one row."""
    keys = ["aspect", "doc_id", "dl"]
    for rows, number in _runs(batches, keys):
        split = pc.ascii_split_whitespace(rows.column("text").combine_chunks().fill_null(""))
        tokens = split.flatten()
        owner = np.repeat(number, np.diff(np.asarray(split.offsets)))
        some = np.asarray(pc.greater(pc.binary_length(tokens), 0))
        tokens, owner = tokens.filter(pa.array(some)), owner[some]
        vocabulary = pc.unique(tokens)
        vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
        term = np.asarray(pc.index_in(tokens, value_set=vocabulary)).astype(np.int64)
        key, tf = np.unique(owner * max(1, len(vocabulary)) + term, return_counts=True)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        offsets = pa.array(np.searchsorted(key, np.arange(len(first) + 1) * max(1, len(vocabulary))), pa.int32())
        terms = vocabulary.take(pa.array(key % max(1, len(vocabulary))))
        kept = rows.select(keys).take(pa.array(first)).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*[kept.column(k).combine_chunks() for k in keys], pa.ListArray.from_arrays(offsets, terms),
             pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=[*keys, "terms", "tfs"])


def _blocked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``size`` postings from rows sorted by aspect, term, part and falling impact; ids rise inside a block."""
    keys = ["aspect", "term", "part"]
    for rows, number in _runs(batches, keys):
        place = np.arange(len(number)) - np.searchsorted(number, number)
        first = np.flatnonzero(place % size == 0)
        ids = np.asarray(rows.column("doc_id"))
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        order = pa.array(np.lexsort((np.asarray(rows.column("tf")), ids, own)))
        kept = rows.select([*keys, "i"]).take(pa.array(first)).combine_chunks()
        offsets = pa.array(np.append(first, len(ids)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).take(order).combine_chunks()) for c in ("doc_id", "tf")]
        yield pa.RecordBatch.from_arrays(
            [*[kept.column(k).combine_chunks() for k in keys], pa.array(place[first] // size, pa.int64()),
             kept.column("i").combine_chunks(), pa.array(np.diff(np.append(first, len(ids))), pa.int32()), *lists],
            names=[*keys, "block", "impact", "n", "ids", "tfs"])


def store(chunks: DataFrame, path: str | None = None, epsilon: float = BM25_EPSILON) -> str:
    """Write the index of aspect, doc_id, text; returns its folder."""
    spark = chunks.sparkSession
    path = path or shared_path(spark, "bm25-index")
    rows = chunks.select("aspect", "doc_id", F.size(lexical.tokens("text")).alias("dl"), "text")
    rows.repartition("aspect", "doc_id").sortWithinPartitions("aspect", "doc_id", "dl") \
        .mapInArrow(_forward, SCHEMAS["chunks"]).write.parquet(f"{path}/chunks")
    forward = _read(spark, path, "chunks")
    asp = chunks.groupBy("aspect").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(lexical.tokens("text"))).alias("avgdl"))
    asp = asp.persist(StorageLevel.MEMORY_AND_DISK)
    raw = forward.select("aspect", F.explode("terms").alias("term")).groupBy("aspect", "term").agg(
        F.count(F.lit(1)).alias("df")).join(asp, "aspect").withColumn(
        "raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)          # read for the mean and for the terms
    mean = raw.groupBy("aspect").agg((F.lit(epsilon) * F.avg("raw")).alias("eps"))
    asp.join(mean, "aspect", "left").select("aspect", "n_docs", "avgdl", "eps").write.parquet(f"{path}/aspects")
    aspects = _read(spark, path, "aspects")
    raw.select("aspect", "term", "df", "raw").join(aspects.select("aspect", "eps"), "aspect").select(
        "aspect", "term", "df", F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf")) \
        .write.parquet(f"{path}/terms")
    raw.unpersist()
    asp.unpersist()
    # only terms in more than PART_ROWS chunks have parts: a small table, known as such before the join
    many = f"{path}-many"
    _read(spark, path, "terms").where(F.col("df") > PART_ROWS).select(
        "aspect", "term", F.ceil(F.col("df") / PART_ROWS).alias("parts")).write.parquet(many)
    parts = spark.read.schema("aspect string, term string, parts long").parquet(many)
    flat = forward.select("aspect", "doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(
        "aspect", "doc_id", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    sized = flat.join(aspects.select("aspect", "avgdl"), "aspect").join(parts, ["aspect", "term"], "left")
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    sized = sized.select("aspect", "term", part.alias("part"), "doc_id", "tf",
                         _impact(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("i"))
    size = BLOCK
    blocks = sized.repartition("aspect", "term", "part").sortWithinPartitions("aspect", "term", "part", F.desc("i"), "doc_id").mapInArrow(
        lambda batches: _blocked(batches, size), "aspect string, term string, part int, block long, impact double, n int, ids array<bigint>, tfs array<bigint>")
    blocks.withColumn("bucket", _bucket(F.col("term"))).write.partitionBy("bucket").parquet(f"{path}/postings")
    return path


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> StoredIndex:
    return StoredIndex(*[_read(spark, path, name) for name in ("postings", "terms", "aspects", "chunks")])


@dataclass
class Search:
    ranked: DataFrame    # query_id, aspect, doc_id, score, rank
    read: DataFrame      # query_id, aspect, term, n: blocks whose postings were read, with their rows
    every: DataFrame     # the same for all blocks of the queries' terms


def search(index: StoredIndex, queries: DataFrame, query_aspects: DataFrame, n: int = RETRIEVAL_TOP_N) -> Search:
    spark = queries.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pair = ["query_id", "aspect"]
    wanted = kept(lexical.wanted_terms(index.terms, index.aspects, queries, query_aspects)
                  .withColumn("bucket", _bucket(F.col("term"))), "bm25-wanted")
    # 1. headers only: the postings themselves are not read
    heads = kept(wanted.join(index.postings.select("aspect", "term", "part", "block", "impact", "n", "bucket"), ["bucket", "aspect", "term"])
                 .select(*pair, "term", "part", "block", "n", "bucket", "eps", (F.col("qtf") * F.col("idf") * F.col("impact")).alias("bound")),
                 "bm25-heads")
    tops = heads.groupBy(*pair, "term").agg(F.max("bound").alias("top"))
    whole = Window.partitionBy(*pair)
    rising = whole.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = tops.select(*pair, "term", "top", F.sum("top").over(whole).alias("all"), F.sum("top").over(rising).alias("risen"))

    # 2. a score that n chunks reach
    falling = whole.orderBy(F.desc("bound"), "term", "part", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = heads.withColumn("_before", F.sum("n").over(falling) - F.col("n")).filter(F.col("_before") < FIRST * n)
    first = first.select(*pair, "term", "part", "block", "n", "bucket")
    parts = _parts(index, first, wanted).groupBy(*pair, "doc_id").agg(F.sum("part_score").alias("s"))
    reached = lexical.rank_within(parts, pair, "s", "doc_id", n).filter(F.col("rank") == n).select(*pair, F.col("s").alias("least"))

    # 3. blocks that may hold one of the first n
    judged = heads.join(tops, [*pair, "term"]).join(reached, pair, "left")
    may = (F.col("risen") >= F.col("least") - SLACK) & (F.col("bound") + F.col("all") - F.col("top") >= F.col("least") - SLACK)
    open_ = kept(judged.filter(F.col("least").isNull() | (F.col("eps") < 0) | may).select(*pair, "term", "part", "block", "n", "bucket", "eps"),
                 "bm25-open")
    blocks = ["bucket", "aspect", "term", "part", "block"]
    found = index.postings.join(open_.where(F.col("eps").isNull() | (F.col("eps") >= 0)).select(*blocks).distinct(), blocks, "left_semi") \
        .select("aspect", F.explode("ids").alias("doc_id")).distinct()

    # 4. whole scores of the candidates; where idf values are negative, of all chunks
    neg = index.aspects.where(F.col("eps") < 0).select("aspect")
    rows = index.chunks.join(found, ["aspect", "doc_id"], "left_semi").unionByName(index.chunks.join(neg, "aspect", "left_semi"))
    count = lexical.block_count(index.chunks, F.size("terms") * 16 + 64, lexical.BLOCK_BYTES)
    scores = lexical.best_in_blocks(rows, count, lexical.list_counts, False, wanted, index.aspects, query_aspects, n)
    ranked = lexical.padded(scores, index.chunks.select("aspect", "doc_id"), index.aspects, query_aspects, n)
    open_ = open_.drop("eps")
    read = open_.unionByName(first).distinct()
    return Search(ranked, read.select(*pair, "term", "n"), heads.select(*pair, "term", "n"))


def _listed(index: StoredIndex, blocks: DataFrame) -> DataFrame:
    """The postings of blocks: query_id, aspect, term, doc_id, tf."""
    full = index.postings.select("bucket", "aspect", "term", "part", "block", "ids", "tfs")
    hit = full.join(blocks.drop("n"), ["bucket", "aspect", "term", "part", "block"])
    return hit.select("query_id", "aspect", "term", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select(
        "query_id", "aspect", "term", F.col("x.ids").alias("doc_id"), F.col("x.tfs").alias("tf"))


def _parts(index: StoredIndex, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """What each posting of the blocks adds: query_id, aspect, doc_id, part_score."""
    rows = _listed(index, blocks).join(wanted.select("query_id", "aspect", "term", "qtf", "idf", "avgdl"), ["query_id", "aspect", "term"])
    rows = rows.join(index.chunks.select("aspect", "doc_id", "dl"), ["aspect", "doc_id"])
    return rows.select("query_id", "aspect", "doc_id", (F.col("qtf") * F.col("idf") * _impact(
        F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("part_score"))
