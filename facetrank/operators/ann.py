"""Inverted-file index for cosine top-n per (query, aspect), probed in order of likelihood.

Index (two tables in the shared folder):
* members: vectors by cell.  A coarse k-means over a bounded sample gives at most COARSE directions; a coarse group of an
  aspect is dealt to parts of about PART_ROWS rows and each part is split by a k-means of its own into cells of about
  CELL_ROWS rows.  So cells stay small and their number grows with the corpus, whatever group a row falls in.
* cells: centre, rows and radius of each cell; the radius is the angle from the centre that covers ``cover`` of its rows.

Search, for a whole query batch:
1. each query ranks the cells of its aspects by the largest cosine a row of the cell can have, cos(angle - radius), and probes
   the first ones until they hold FIRST x n rows;
2. the n-th best cosine found so far is its threshold; of the other cells only those whose bound reaches the threshold are
   probed, each block of queries once for a cell.
With ``cover`` = 1 no row within the first n is ever missed, however many cells are skipped; a smaller ``cover`` ignores the
outermost rows when cells are ruled out, skips more, and loses a few.

Order and rounding are those of ``dense``.  How much is skipped depends on the vectors: on vectors without any structure no bound
excludes anything (see README).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import RETRIEVAL_TOP_N
from ..session import shared_path
from .dense import _matrix, _unit
from .lexical import RANK_DIGITS, rank_within

COARSE = 256          # directions of the coarse k-means, at most
SAMPLE = 32_768       # vectors it is fitted on, at most
ROUNDS = 8
PART_ROWS = 65_536    # rows of a part of a coarse group
CELL_ROWS = 64
FIRST = 2             # first probes hold this many times n rows
CELL_BLOCKS = 16      # blocks of cells that are ranked apart
QUERY_BLOCK = 256
SLACK = 2e-9          # cosines are ranked on 9 decimals


@dataclass
class IvfIndex:
    members: DataFrame   # cell, doc_id, aspect, vector
    cells: DataFrame     # cell, aspect, centre, radius, n


def k_means(m: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """k directions (fewer if some are empty) of the unit rows of m."""
    k = min(k, len(m))
    centres = m[np.random.default_rng(seed).choice(len(m), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        centres = _unit(sums[np.linalg.norm(sums, axis=1) > 0])
    return centres


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(vectors: DataFrame, cover: float = 1.0, cell_rows: int = CELL_ROWS) -> IvfIndex:
    """Index of doc_id, aspect, vector; rows without a vector are left out."""
    spark = vectors.sparkSession
    rows = vectors.select("doc_id", "aspect", F.col("vector").cast("array<double>").alias("vector")) \
        .filter(F.size("vector") > 0)
    sample = rows.select("vector", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(SAMPLE)
    taken = sample.select("vector").toArrow()
    unit = _unit(_matrix(taken.column("vector"))) if taken.num_rows else np.zeros((0, 1))
    coarse = k_means(unit, min(COARSE, max(1, int(len(unit) ** 0.5)))) if len(unit) else unit
    shared = spark.sparkContext.broadcast(coarse)

    def place(batches):
        for b in batches:
            m = _unit(_matrix(pa.Table.from_batches([b]).column("vector")))
            yield b.append_column("coarse", pa.array(np.argmax(m @ shared.value.T, axis=1).astype(np.int32)))

    placed = rows.mapInArrow(place, "doc_id long, aspect string, vector array<double>, coarse int") if len(unit) else \
        rows.withColumn("coarse", F.lit(0))
    size = placed.groupBy("aspect", "coarse").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    placed = placed.join(size, ["aspect", "coarse"]).withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")

    def split(table: pa.Table) -> pa.Table:
        m = _unit(_matrix(table.column("vector")))
        by = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        centres = k_means(m[by], max(1, len(m) // cell_rows))
        cell = np.argmax(m @ centres.T, axis=1)
        first = [table.column(c)[0].as_py() for c in ("aspect", "coarse", "part")]
        names = pa.array([f"{first[0]}/{first[1]}/{first[2]}/{c}" for c in cell.tolist()])
        return pa.table([names, table.column("doc_id"), table.column("aspect"), table.column("vector")],
                        names=["cell", "doc_id", "aspect", "vector"])

    cells_of = placed.groupBy("aspect", "coarse", "part").applyInArrow(
        split, "cell string, doc_id long, aspect string, vector array<double>")
    members = _stored(cells_of, "ivf-members")

    def measure(table: pa.Table) -> pa.Table:
        m = _unit(_matrix(table.column("vector")))
        centre = _unit(m.sum(0, keepdims=True))[0]
        angle = np.sort(np.arccos(np.clip(m @ centre, -1, 1)))
        reach = angle[min(len(angle), max(1, int(np.ceil(cover * len(angle))))) - 1]
        return pa.table([table.column("cell").slice(0, 1), table.column("aspect").slice(0, 1),
                         pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(reach)]),
                         pa.array([len(m)], pa.int64())], names=["cell", "aspect", "centre", "radius", "n"])

    cells = _stored(members.groupBy("cell").applyInArrow(
        measure, "cell string, aspect string, centre array<double>, radius double, n long"), "ivf-cells")
    return IvfIndex(members, cells)


def _ranked_cells(index: IvfIndex, asked: DataFrame, n: int, rest: bool) -> DataFrame:
    """query_id, aspect, cell, bound, n of the cells worth a probe: by block the best ones, or those that reach ``least``."""
    block = F.pmod(F.xxhash64("cell"), F.lit(CELL_BLOCKS)).cast("int")
    queries = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(CELL_BLOCKS - 1))))
    cells = index.cells.select("cell", F.col("aspect").alias("of"), "centre", "radius", "n", block.alias("at"))

    def bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, c = _unit(_matrix(left.column("vector"))), _matrix(right.column("centre"))
            radius, rows = right.column("radius").to_numpy(), right.column("n").to_numpy()
            least = left.column("least").to_numpy()
            for s in range(0, len(q), QUERY_BLOCK):
                angle = np.arccos(np.clip(q[s:s + QUERY_BLOCK] @ c.T, -1, 1))
                bound = np.cos(np.maximum(0, angle - radius))
                if rest:
                    i, j = np.nonzero(bound >= least[s:s + QUERY_BLOCK, None] - SLACK)
                else:
                    by = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(rows[by], axis=1) - rows[by]
                    i, k = np.nonzero(before < FIRST * n)
                    j = by[i, k]
                out.append((i + s, j, bound[i, j]))
        i, j, bound = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
        return pa.table([left.column("query_id").take(i), left.column("aspect").take(i), right.column("cell").take(j),
                         pa.array(bound.astype(float)), right.column("n").take(j)],
                        names=["query_id", "aspect", "cell", "bound", "n"])

    return queries.groupBy("aspect", "block").cogroup(cells.groupBy("of", "at")).applyInArrow(
        bounds, "query_id long, aspect string, cell string, bound double, n long")


def _probed(index: IvfIndex, asked: DataFrame, probes: DataFrame, n: int) -> DataFrame:
    """query_id, aspect, doc_id, sim: the best n rows of each probed cell."""
    wanted = probes.select("query_id", "aspect", F.col("cell").alias("at")).join(
        asked.select("query_id", "aspect", "vector"), ["query_id", "aspect"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, m = _unit(_matrix(left.column("vector"))), _unit(_matrix(right.column("vector")))
            ids = right.column("doc_id").to_numpy()
            for s in range(0, len(q), QUERY_BLOCK):
                sims = q[s:s + QUERY_BLOCK] @ m.T
                rounded = np.round(sims, RANK_DIGITS)
                by = np.lexsort((np.broadcast_to(ids, sims.shape), -rounded), axis=1)[:, :n]
                i = np.repeat(np.arange(len(sims)), by.shape[1])
                j = by.reshape(-1)
                out.append((i + s, ids[j], sims[i, j]))
        i, doc, sim = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        i = pa.array(i.astype(np.int64))
        return pa.table([left.column("query_id").take(i), left.column("aspect").take(i), pa.array(doc.astype(np.int64)),
                         pa.array(sim.astype(float))], names=["query_id", "aspect", "doc_id", "sim"])

    return wanted.groupBy("at").cogroup(index.members.groupBy("cell")).applyInArrow(
        compare, "query_id long, aspect string, doc_id long, sim double")


@dataclass
class IvfSearch:
    ranked: DataFrame    # query_id, aspect, doc_id, sim, rank
    probes: DataFrame    # query_id, aspect, cell, n: every cell that was compared, with its rows


def search(index: IvfIndex, query_vectors: DataFrame, query_aspects: DataFrame | None = None,
           n: int = RETRIEVAL_TOP_N) -> IvfSearch:
    q = query_vectors.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    aspects = index.cells.select("aspect").distinct()
    pairs = query_aspects.select("query_id", "aspect").distinct() if query_aspects is not None else None
    if pairs is None:                                    # the aspects are a fixed, small set
        every = aspects.agg(F.collect_set("aspect")).scalar()
        asked = q.withColumn("_all", every).select("query_id", "vector", F.explode("_all").alias("aspect"))
    else:
        asked = q.join(pairs, "query_id")
    asked = asked.select("query_id", "aspect", "vector")
    near = _ranked_cells(index, asked.withColumn("least", F.lit(-2.0)), n, rest=False)
    order = Window.partitionBy("query_id", "aspect").orderBy(F.desc("bound"), "cell")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = _stored(near.withColumn("_before", before).filter(F.col("_before") < FIRST * n)
                    .select("query_id", "aspect", "cell", "n"), "ivf-first")
    found = _stored(rank_within(_probed(index, asked, first, n), ["query_id", "aspect"], "sim", "doc_id", n), "ivf-found")
    least = found.filter(F.col("rank") == n).select("query_id", "aspect", F.col("sim").alias("least"))
    more = asked.join(least, ["query_id", "aspect"], "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    rest = _ranked_cells(index, more, n, rest=True).join(first.drop("n"), ["query_id", "aspect", "cell"], "left_anti")
    rest = _stored(rest.select("query_id", "aspect", "cell", "n"), "ivf-rest")
    both = found.drop("rank").unionByName(_probed(index, asked, rest, n))
    return IvfSearch(rank_within(both, ["query_id", "aspect"], "sim", "doc_id", n), first.unionByName(rest))


def dense_topk_ivf(corpus: DataFrame, query_vectors: DataFrame, query_aspects: DataFrame | None = None,
                   n: int = RETRIEVAL_TOP_N, cover: float = 1.0) -> DataFrame:
    """Cosine top-n per (query, aspect) through an index built for the call: query_id, aspect, doc_id, sim, rank."""
    return search(build_index(corpus, cover), query_vectors, query_aspects, n).ranked
