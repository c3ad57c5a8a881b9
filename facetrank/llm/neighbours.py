"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected on M Gaussian (2-stable) directions: for a distance d, the squared projected distance
over d^2 follows a chi-square law of M degrees of freedom.  A kd-tree over the projections yields a
query's projected neighbours step by step; each is verified by its true distance.  The walk stops once
the next projected distance r and the k-th best true distance d satisfy chi2_M(r^2 / d^2) > STOP: a
vector nearer than d would then have shown up earlier with probability STOP.

The tree has two levels.  Its top splits, medians of a bounded sample of the projections, cut the table
into cells; every vector is in one cell, none is left out.  A cell's own tree is built in the task
that holds it.  Queries go first to the cells nearest to their projection; with the k-th distance
found there, the same chi-square test tells which other cells they must visit.  Queries travel in
rows of their own to these cells, in blocks; nothing is broadcast but the splits.

Vectors that are null, zero, or hold null or non-finite components take no part.  Vectors of other
lengths are no candidates of a query.  Repeated rows are found each; equal distances sort by id; fewer
candidates than k are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready, written

M = 8               # projections
K = 10              # neighbours of a query
STOP = 0.97         # confidence of the stopping test
SAMPLE = 8192       # vectors that place the top splits
CELL_ROWS = 8192    # rows of a cell, about
MAX_CELLS = 2048    # cells of the top splits at most; fuller cells are dealt out by id
LEAF = 64           # rows of a leaf
FIRST_CELLS = 2     # cells a query visits at first
QUERY_BLOCK = 256   # queries of a cell handled at once


def chi2_cdf(x: np.ndarray, m: int = M) -> np.ndarray:
    """Chi-square distribution of an even number m of degrees of freedom."""
    x = np.minimum(np.asarray(x, dtype=float), 1e4)
    term, total = np.ones_like(x), np.ones_like(x)
    for j in range(1, m // 2):
        term = term * (x / 2) / j
        total = total + term
    return 1 - np.exp(-x / 2) * total


def chi2_bound(p: float = STOP, m: int = M) -> float:
    """x with chi2_cdf(x) = p: the test r^2 / d^2 > x needs no distribution function per step."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(np.array(mid), m) < p else (lo, mid)
    return hi


def directions(dim: int, m: int = M, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


def usable(vector: Column) -> Column:
    """True for vectors with only finite components, not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


class Splits:
    """The top of a kd-tree: ``depth`` levels of median splits over sample points, as arrays by heap index."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, m = depth, points.shape[1]
        self.axis = np.zeros(2 ** depth, dtype=int)
        self.cut = np.zeros(2 ** depth)
        self.low = np.full((2 ** (depth + 1), m), -np.inf)
        self.high = np.full((2 ** (depth + 1), m), np.inf)
        groups = {1: points}
        for node in range(1, 2 ** depth):
            p = groups.pop(node)
            spread = p.max(0) - p.min(0) if len(p) else np.zeros(m)
            a = int(np.argmax(spread))
            c = float(np.median(p[:, a])) if len(p) else 0.0
            self.axis[node], self.cut[node] = a, c
            for child, part in ((2 * node, p[p[:, a] <= c]), (2 * node + 1, p[p[:, a] > c])):
                groups[child] = part
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, a] = c
            self.low[2 * node + 1, a] = c

    @property
    def cells(self) -> int:
        return 2 ** self.depth

    def cell_of(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), dtype=int)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - self.cells

    def squared_gap(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance of each point (rows) to each cell's box (columns)."""
        low, high = self.low[self.cells:], self.high[self.cells:]
        gap = np.maximum(0, np.maximum(low[None] - p[:, None], p[:, None] - high[None]))
        return (gap ** 2).sum(2)


class Tree:
    """The kd-tree of one cell: leaves of about LEAF rows, with the boxes of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        parts, todo = [], [order]
        while todo:
            i = todo.pop()
            if len(i) <= leaf:
                parts.append(i)
                continue
            p = projected[i]
            a = int(np.argmax(p.max(0) - p.min(0)))
            i = i[np.argsort(p[:, a], kind="stable")]
            todo += [i[:len(i) // 2], i[len(i) // 2:]]
        self.leaves = parts
        self.low = np.array([projected[i].min(0) for i in parts])
        self.high = np.array([projected[i].max(0) for i in parts])
        self.ids, self.vectors = ids, vectors

    def search(self, qid: np.ndarray, q: np.ndarray, qp: np.ndarray, d: np.ndarray, k: int,
               bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and row numbers (-1: none) of the k best per query, which start at squared distance d."""
        n = len(q)
        best = np.repeat(d[:, None], k, axis=1)
        rows = np.full((n, k), -1)
        gap = np.maximum(0, np.maximum(self.low[None] - qp[:, None], qp[:, None] - self.high[None]))
        gap = (gap ** 2).sum(2)
        walk = np.argsort(gap, axis=1, kind="stable")
        active = np.arange(n)
        for step in range(len(self.leaves)):
            at = walk[active, step]
            active_gap = gap[active, at]
            kth = best[active, k - 1]
            with np.errstate(invalid="ignore"):
                go = ~(active_gap > bound * kth)       # the chi-square stopping test
            active, at = active[go], at[go]
            if not len(active):
                break
            for leaf in np.unique(at):
                who = active[at == leaf]
                i = self.leaves[leaf]
                dist = ((q[who][:, None] - self.vectors[i][None]) ** 2).sum(2)
                dist[qid[who][:, None] == self.ids[i][None]] = np.inf
                alld = np.concatenate([best[who], dist], axis=1)
                allr = np.concatenate([rows[who], np.broadcast_to(i, (len(who), len(i)))], axis=1)
                tie = np.where(allr >= 0, self.ids[allr], np.iinfo(np.int64).max)
                pick = np.lexsort((tie, alld), axis=1)[:, :k]
                best[who] = np.take_along_axis(alld, pick, 1)
                rows[who] = np.where(np.isfinite(best[who]), np.take_along_axis(allr, pick, 1), -1)
        return best, rows


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, stop: float = STOP, id_col: str = "vec_id",
            vector_col: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other vectors."""
    spark = vectors.sparkSession
    ready(spark)
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("v"),
                           is_query.alias("query")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    clean = clean.withColumn("dim", F.size("v"))
    found, bound = None, chi2_bound(stop)
    # vectors of one length make up a search of their own
    for row in clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("long")).alias("q")) \
            .orderBy(F.desc("n"), "dim").collect():
        if row["q"]:
            part = _search(clean.filter(F.col("dim") == row["dim"]).drop("dim"), row["dim"], row["n"], k, bound, cell_rows)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                                     F.lit(0.0).alias("score"))
    return found


def _search(clean: DataFrame, dim: int, n: int, k: int, bound: float, cell_rows: int) -> DataFrame:
    a = directions(dim)
    depth = max(0, math.ceil(math.log2(max(1, n / cell_rows))))
    few = clean.select("v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE) if depth else clean.select("v").limit(1)
    splits = Splits(np.array([r["v"] for r in few.collect()]).reshape(-1, dim) @ a, min(depth, int(math.log2(MAX_CELLS))))

    def place(batches):
        for b in batches:
            v = _matrix(b.column("v"))
            cell = splits.cell_of(v @ a) if len(v) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("query"),
                                              pa.array(cell, pa.int32())], names=["vec_id", "v", "query", "cell"])

    index = written(clean.mapInArrow(place, "vec_id long, v array<double>, query boolean, cell int"), "ann-index")
    # a cell of many rows (one vector may hold a third of them) is dealt out by id, one tree for each share;
    # the counts that come to the driver are one per cell, at most MAX_CELLS
    counts = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    shares = np.array([max(1, math.ceil(counts.get(c, 0) / (2 * cell_rows))) for c in range(splits.cells)])
    index = index.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.element_at(
        F.array(*[F.lit(int(x)) for x in shares]), F.col("cell") + 1)).cast("int"))
    queries = index.filter("query").select(F.col("vec_id").alias("query_id"), "v")
    # the same id may name several query rows: they count as one query
    queries = queries.groupBy("query_id").agg(F.min("v").alias("v"))

    def visits(batches, second: bool):
        for b in batches:
            q = _matrix(b.column("v"))
            if not len(q):
                continue
            gap = splits.squared_gap(q @ a)
            rank = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1, kind="stable")
            if second:
                d = np.asarray(b.column("d"), dtype=float)
                with np.errstate(invalid="ignore"):
                    go = (rank >= FIRST_CELLS) & ~(gap > bound * d[:, None])
            else:
                d = np.full(len(q), np.inf)
                go = rank < FIRST_CELLS
            row, cell = np.nonzero(go)
            share = np.concatenate([np.arange(x) for x in shares[cell]]) if len(cell) else cell
            row, cell = np.repeat(row, shares[cell]), np.repeat(cell, shares[cell])
            for s in range(0, len(row), 4096):
                r, e = row[s:s + 4096], slice(s, s + 4096)
                yield pa.RecordBatch.from_arrays(
                    [b.column("query_id").take(pa.array(r)), b.column("v").take(pa.array(r)), pa.array(d[r]),
                     pa.array(cell[e], pa.int32()), pa.array(share[e], pa.int32())],
                    names=["query_id", "v", "d", "cell", "share"])

    def cell_search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "sq": []}
        if len(left) and len(right):
            v = _matrix(right.column("v"))
            tree = Tree(np.asarray(right.column("vec_id")), v, v @ a)
            qid, q, d = np.asarray(left.column("query_id")), _matrix(left.column("v")), np.asarray(left.column("d"))
            for s in range(0, len(qid), QUERY_BLOCK):
                e = slice(s, s + QUERY_BLOCK)
                best, rows = tree.search(qid[e], q[e], q[e] @ a, d[e], k, bound)
                who, col = np.nonzero(rows >= 0)
                out["query_id"].append(qid[e][who])
                out["vec_id"].append(tree.ids[rows[who, col]])
                out["sq"].append(best[who, col])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        return pa.table([pa.array(cat(out["query_id"], np.int64)), pa.array(cat(out["vec_id"], np.int64)),
                         pa.array(cat(out["sq"], np.float64))], names=["query_id", "vec_id", "sq"])

    visit = "query_id long, v array<double>, d double, cell int, share int"
    best_k = F.row_number().over(Window.partitionBy("query_id").orderBy("sq", "vec_id"))

    def round_of(plan: DataFrame) -> DataFrame:
        return plan.groupBy("cell", "share").cogroup(index.select("vec_id", "v", "cell", "share").groupBy("cell", "share")).applyInArrow(
            cell_search, "query_id long, vec_id long, sq double")

    one = written(round_of(queries.mapInArrow(lambda b: visits(b, False), visit)), "ann-round")
    kth = one.withColumn("r", best_k).filter(F.col("r") == k).select("query_id", F.col("sq").alias("d"))
    again = queries.join(kth, "query_id", "left").withColumn("d", F.coalesce("d", F.lit(float("inf"))))
    two = round_of(again.mapInArrow(lambda b: visits(b, True), visit))
    return (one.unionByName(two).withColumn("rank", best_k).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("sq").alias("score")))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
