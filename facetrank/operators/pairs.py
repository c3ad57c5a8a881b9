"""Scores of all pairs that a hard filter lets through, worked out block by block as matrix products.

A pair is a user and a hall of equal keys whose price is within the user's ceiling.  Both sides are dealt, class of
keys by class, to parts of at most about USERS users and HALLS halls; a task meets one part of each, so no class is ever
held whole, pairs are only made where they are scored, and vectors are sent per row, not per pair.

    score = sum over features f of w[f] * q[f] * cos(user vector, hall's vector f)   (without vectors: of w[f] * q[f])
    base  = product or cosine of the user's and the hall's own vector (null where one has none)

Missing vectors, weights and qualities add nothing.  Repeated rows count as the joins of their rows would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import NORM_FLOOR
from .lexical import RANK_DIGITS, rank_within
from .topk import _dense, best

USERS = 2_048
HALLS = 512          # every pair of a block is a row
TOP_HALLS = 8_192    # with a top n, a block sends n rows a user
CHUNK = 256
MEET_USERS = 8_192   # a plain join holds no pairs: parts are as large as lets all cores share the work
MEET_HALLS = 2_048
MEETINGS = 4         # of a task


def counted(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The rows with the number of rows equal in the columns."""
    return rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*columns)))


def there(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without a null in the columns."""
    return rows.where(~F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)))


def _units(lists: pa.Array, d: int, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows (scaled to length 1 with ``unit``), and which of them are whole vectors of length d."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    gap = np.zeros(len(lists), dtype=bool)
    if flat.null_count:
        gap[np.repeat(np.arange(len(lists)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (size == d) & ~gap
    out = np.zeros((len(lists), d))
    if ok.any():
        out[ok] = flat.to_numpy(zero_copy_only=False)[np.repeat(ok, size)].reshape(-1, d)
        if unit:
            out /= np.maximum(np.sqrt((out ** 2).sum(1)), NORM_FLOOR)[:, None]
    return out, ok


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _sums(column, d: int) -> np.ndarray:
    """The sum of the unit vectors of each row's list."""
    lists = _array(column)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), d))
    np.add.at(out, np.repeat(np.arange(len(lists)), size), _units(lists.flatten(), d, True)[0])
    return out


def _terms(column, features: list[str], d: int) -> np.ndarray:
    """hall x feature x d: per feature the sum of quality times unit vector (without vectors: of the qualities)."""
    lists = _array(column)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    out = np.zeros((len(lists), len(features), d))
    at = pc.fill_null(pc.index_in(flat.field("feature"), value_set=pa.array(features, pa.string())), -1).to_numpy(zero_copy_only=False)
    q = flat.field("q")
    there = q.is_valid().to_numpy(zero_copy_only=False) & (at >= 0)
    q = pc.fill_null(q, 0.0).to_numpy(zero_copy_only=False)
    v, ok = (_units(flat.field("v"), d, True) if "v" in [f.name for f in flat.type] else (np.ones((len(q), 1)), there))
    there = there & ok
    np.add.at(out, (np.repeat(np.arange(len(lists)), size)[there], at[there]), v[there] * q[there, None])
    return out


def _width(column, depth: int) -> int:
    lists = _array(column)
    for _ in range(depth):
        lists = lists.flatten()
    return pc.max(pc.list_value_length(lists)).as_py() or 0


def part_counts(users: DataFrame, halls: DataFrame, keys: list[str], most_users: int, most_halls: int) -> DataFrame:
    """Per class of keys that both sides have, the parts that its users (ups) and its halls (hps) are dealt to."""
    parts = lambda rows, size, name: rows.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    return parts(users, most_users, "ups").join(parts(halls, most_halls, "hps"), keys)


def meeting_counts(users: DataFrame, halls: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """As ``part_counts``, for joins that hold no pairs: about MEETINGS meetings a task in all, a class's by its share of the pairs.

    Parts of a fixed size would copy each user as often as its class has parts of halls, users times halls in all.  Here the
    parts of a class are no more than its meetings, cut so that the rows copied are fewest."""
    rows = lambda x, name: x.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(name))
    sizes = rows(users, "us").join(rows(halls, "hs"), keys)
    every = sizes.agg(F.sum(F.col("us") * F.col("hs"))).scalar()
    meetings = F.ceil(F.col("us") * F.col("hs") / every * (MEETINGS * tasks))
    hps = F.least(F.ceil(F.col("hs") / MEET_HALLS), F.ceil(F.sqrt(meetings * F.col("hs") / F.col("us"))))
    ups = F.least(F.ceil(F.col("us") / MEET_USERS), F.ceil(meetings / F.col("hps")))
    return sizes.withColumn("hps", hps.cast("int")).withColumn("ups", ups.cast("int")).drop("us", "hs")


def dealt(users: DataFrame, halls: DataFrame, sizes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with up and hp: a row is copied to each part of the other side, and meets each row of it once."""
    u = users.join(sizes, keys).withColumn("up", F.pmod(F.xxhash64("user_id"), "ups").cast("int")).withColumn(
        "hp", F.explode(F.sequence(F.lit(0), F.col("hps") - 1)))
    h = halls.join(sizes, keys).withColumn("hp", F.pmod(F.xxhash64("id"), "hps").cast("int")).withColumn(
        "up", F.explode(F.sequence(F.lit(0), F.col("ups") - 1)))
    return u.drop("ups", "hps"), h.drop("ups", "hps")


def equal_pairs(users: DataFrame, halls: DataFrame, keys: list[str]) -> DataFrame:
    """The join of users and halls on the keys, whose rows grow with their product.

    A class of keys may be a large share of all pairs, and both sides are small beside them: joined on the keys alone, they end
    up in one task, or one a class.  Here a class is dealt to parts, and all cores share the meetings of two parts.
    """
    # a number that is given is kept, however few bytes the sides have
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u, h = (x.repartition(tasks, *keys, "up", "hp") for x in dealt(users, halls, meeting_counts(users, halls, keys, tasks), keys))
    return u.join(h, [*keys, "up", "hp"]).drop("up", "hp")


def scored_pairs(users: DataFrame, halls: DataFrame, keys: list[str], weights: DataFrame | None, terms: DataFrame | None,
                 vectors: DataFrame | None = None, base: str | None = None, n: int | None = None) -> DataFrame:
    """The pairs, with score, base (if asked for) and the columns that users and halls carry beyond those named here.

    users:   user_id, keys, _times (and _ceiling: highest price; and uvec for a base)
    halls:   id, keys, _copies (and price; and hvec for a base)
    weights: user_id, w (feature -> weight)
    terms:   id, terms (an array of feature, q and, with vectors, v)
    vectors: user_id, us (the user's vectors)
    base:    "dot", "cosine" or None
    n:       only each user's first n by score, then id
    """
    capped = "_ceiling" in users.columns
    known = {"user_id", "id", "_times", "_copies", "_ceiling", "price", "uvec", "hvec", *keys}
    carry_u, carry_h = ([c for c in x.columns if c not in known] for x in (users, halls))
    users = there(users, [*keys, *(["_ceiling"] if capped else [])])
    halls = there(halls, [*keys, *(["price"] if capped else [])])
    sizes = part_counts(users, halls, keys, USERS, HALLS if n is None else TOP_HALLS)
    u = users.join(weights, "user_id", "left") if weights is not None else users
    u = u.join(vectors, "user_id", "left") if vectors is not None else u
    h = halls.join(terms, "id", "left") if terms is not None else halls
    u, h = dealt(u, h, sizes, keys)
    has_vectors, has_terms = vectors is not None, terms is not None

    types = {f.name: f.dataType.simpleString() for f in [*users.schema, *halls.schema]}
    out_schema = ", ".join(["user_id long", "id long", "score double", *(["base double"] if base else []),
                            *[f"`{c}` {types[c]}" for c in [*carry_u, *carry_h]]])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ids = left.num_rows, right.column("id").to_numpy()
        found: list[tuple] = []
        if rows and len(ids):
            times, copies = left.column("_times").to_numpy(), right.column("_copies").to_numpy()
            x = y = w = b = c = None
            if has_terms:
                maps = left.column("w").to_pylist()
                features = sorted({f for m in maps for f, _ in m or ()})
                w = _dense(maps, features)
                d = _width(left.column("us"), 1) if has_vectors else 1
                x = _sums(left.column("us"), d) if has_vectors else np.ones((rows, 1))
                y = _terms(right.column("terms"), features, d)
            if base:
                d = _width(left.column("uvec"), 0)
                (b, b_ok), (c, c_ok) = (_units(_array(t.column(v)), d, base == "cosine") for t, v in ((left, "uvec"), (right, "hvec")))
            for s in range(0, rows, CHUNK):
                e = min(rows, s + CHUNK)
                score = np.zeros((e - s, len(ids)))
                if has_terms:
                    # a few wide products rather than one a feature
                    xw = (w[s:e, :, None] * x[s:e, None, :]).reshape(e - s, -1)
                    score = xw @ y.reshape(len(ids), -1).T
                    if times[s:e].max() > 1 or copies.max() > 1:
                        score *= times[s:e, None] * copies[None, :]
                fits = np.ones(score.shape, dtype=bool)
                if capped:
                    fits = right.column("price").to_numpy()[None, :] <= left.column("_ceiling").to_numpy()[s:e, None]
                if n is None:
                    i, j = np.nonzero(fits)
                else:
                    i, j = best(np.where(fits, np.round(score, RANK_DIGITS), -np.inf), ids, n)
                own = [score[i, j]]
                if base:
                    value = b[s:e] @ c.T
                    own += [value[i, j], b_ok[s:e][i] & c_ok[j]]
                found.append((i + s, j, *own))
        i, j, score, *own = [np.concatenate([f[p] for f in found]) if found else np.zeros(0) for p in range(5 if base else 3)]
        i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
        cols = {"user_id": left.column("user_id").take(i), "id": right.column("id").take(j), "score": pa.array(score, pa.float64())}
        if base:
            cols["base"] = pa.array(own[0], pa.float64(), mask=~own[1].astype(bool))
        cols |= {c: left.column(c).take(i) for c in carry_u} | {c: right.column(c).take(j) for c in carry_h}
        return pa.table(cols)

    got = u.groupBy(*keys, "up", "hp").cogroup(h.groupBy(*keys, "up", "hp")).applyInArrow(block, out_schema)
    return got if n is None else rank_within(got, ["user_id"], "score", "id", n)
