"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, banded and verified.

A text is its bag of SHINGLE-word shingles.  A shingle weighs its count times the mean inverse document
frequency of its words.  Document frequencies are counted over all texts in SLOTS hashed slots (a fixed size, so the
table fits any task however large the corpus).

Improved consistent weighted sampling draws, for hash k and shingle i of weight S, r and c from
Gamma(2, 1) and b from U(0, 1), and takes t = floor(ln S / r + b), a = c exp(-r (t - b + 1)); the least a
gives the sample (i, t).  Two texts agree on a sample with probability equal to their weighted Jaccard
similarity.  The triple (r, c, b) comes from a table of TRIPLES rows by a hash of (k, i).  For sampling alone,
weights are rounded to a geometric grid of ratio GRID, which makes a a table (of as many levels as the largest
weight needs); ties are broken by a hash of the shingle.

BANDS bands of ROWS samples make the candidates.  Equal word sequences are first made one node.  Candidates are
verified by weighted Jaccard similarity >= THRESHOLD of the whole texts, on the weights as they are; the classes
are the connected components of the verified links, by label propagation with pointer jumping, on tables in the
shared folder.

Candidates come in two passes.  First every member of a bucket is compared with the bucket's least member, and with
the least of the bucket's share it falls in, for SHARES shares by node; this settles groups of copies in linear time.
Then buckets whose members are not yet of one class (a template shared by many texts) are gone through whole, in cells of
two groups of GROUP members.  A cell holds its members' texts and takes pairs of different classes in order of how
many of their samples agree (at least AGREE of BANDS x ROWS, which a pair of similarity THRESHOLD misses with
probability 2e-6); a pair whose classes an earlier pair has joined is passed over, and so is one that the distances to
a few pivots rule out (1 - similarity is a metric).  A cell sends only the links that joined classes: fewer than it has
members.  The cells of a bucket grow with the square of its groups.

n_links counts the links that were verified to form the classes, not all similar pairs of a class.

Edge cases: a text of 1 to SHINGLE - 1 words is one shingle; texts without a word (null, empty, blank) stand alone;
rows are known by doc_id and text, so rows of one doc_id with different texts are of one class only if the texts are
alike, and rows without doc_id belong to the class of their text; a class is named by its least doc_id (null if it has
none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
GRID = 1.1           # ratio of neighbouring weights, in sampling
LEVELS = 128         # levels at first, from GRID**LOWEST; more when a weight needs them
LOWEST = -32
TRIPLES = 1 << 14
SLOTS = 1 << 20
PACK = 1 << 12       # slots that reach the driver as one row
SHARES = 16          # shares of a bucket with a least member of their own
GROUP = 512          # members of a group, when a bucket is gone through whole
PIVOTS = 4
AGREE = 30           # equal samples of a pair worth verifying: P(Binomial(56, 0.8) < 30) = 2e-6
CHUNK = 50_000       # shingles sampled at once
WORDS_HELD = 500_000
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Words(dict):
    """64-bit hashes of words, cached; the cache starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= WORDS_HELD:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: str | bytes) -> np.ndarray:
        # bytes are cut at exactly the six blanks
        w = (text.encode("utf-8", "replace") if isinstance(text, str) else text).split()
        return np.fromiter(map(self.__getitem__, w), dtype=U64, count=len(w))


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and their weights."""
    n = len(words)
    if not n:
        return np.zeros(0, U64), np.zeros(0)
    k = min(SHINGLE, n)
    w = idf[(words & U64(SLOTS - 1)).astype(np.int64)]
    h, weight = np.zeros(n - k + 1, U64), np.zeros(n - k + 1)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mixed(h * U64(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j])
            weight = weight + w[j:n - k + 1 + j]
    by = np.argsort(h, kind="stable")
    h, weight = h[by], weight[by] / k
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    tf = np.diff(np.concatenate([at, [len(h)]]))
    return h[at], tf * weight[at]


def levels(weight: np.ndarray) -> np.ndarray:
    """Places of weights on the sampling grid."""
    return np.maximum(0, np.rint(np.log(weight) / np.log(GRID)).astype(np.int64) - LOWEST)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima over sum of maxima."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


class Sampler:
    """Consistent weighted samples: per hash, the least a over a text's shingles, as a 64-bit key."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r, self.c, self.b = rng.gamma(2, 1, TRIPLES), rng.gamma(2, 1, TRIPLES), rng.random(TRIPLES)
        self.odd = rng.integers(0, 2 ** 63, samples, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self._grow(LEVELS)

    def _grow(self, count: int) -> None:
        self.levels = count
        log_s = (np.arange(count) + LOWEST)[:, None] * np.log(GRID)
        t = np.floor(log_s / self.r + self.b)
        a = np.log(self.c) - self.r * (t - self.b + 1)       # log a, for each level and triple
        # order of a on top (24 bits, the same for any number of levels), the shingle's hash below
        self.rank = np.clip((a + 100) / 120 * 2 ** 24, 0, 2 ** 24 - 1).astype(U64).reshape(-1) << U64(40)

    def __call__(self, h: np.ndarray, level: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """samples x texts keys; text j owns the shingles from starts[j] to the next."""
        if level.max(initial=0) >= self.levels:
            self._grow(int(level.max()) + 1)
        out = np.empty((len(self.odd), len(starts)), dtype=U64)
        base = level.astype(np.int64) * TRIPLES
        with np.errstate(over="ignore"):
            for k, odd in enumerate(self.odd):
                x = h * odd
                x ^= x >> U64(29)
                key = self.rank[base + (x >> U64(50)).astype(np.int64)] | ((x * U64(0x9E3779B97F4A7C15)) >> U64(24))
                out[k] = np.minimum.reduceat(key, starts)
        return out


def word_idf(rows: DataFrame) -> np.ndarray:
    """ln(1 + N / df) of each hashed slot over all texts; SLOTS numbers reach the driver, PACK of them a row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, df, n = Words(), np.zeros(SLOTS, dtype=np.int64), 0
        for b in batches:
            for text in b.column("text"):
                h = words(text.as_py() or b"")
                df[np.unique((h & U64(SLOTS - 1)).astype(np.int64))] += 1
                n += len(h) > 0
        at = [k for k in range(SLOTS // PACK) if df[k * PACK:(k + 1) * PACK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at, -1], pa.int32()), pa.array([df[k * PACK:(k + 1) * PACK].tobytes() for k in at] + [
                np.int64(n).tobytes()], pa.binary())], names=["pack", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table([table.column("pack").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["pack", "counts"])

    df, n = np.zeros(SLOTS), 1
    schema = "pack int, counts binary"
    for r in rows.select("text").mapInArrow(count, schema).groupBy("pack").applyInArrow(add, schema).collect():
        if r["pack"] < 0:
            n = max(1, int(np.frombuffer(r["counts"], np.int64)[0]))
        else:
            df[r["pack"] * PACK:(r["pack"] + 1) * PACK] = np.frombuffer(r["counts"], np.int64)
    return np.log1p(n / np.maximum(1, df))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(rows: DataFrame, idf) -> DataFrame:
    """id, tkey (of the text), digest of the word sequence, the BANDS band keys and the samples (4 bytes each) of every text
    with a word.  Written once."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        words, sampler, weights = Words(), Sampler(), idf.value
        for b in batches:
            held: list = []
            size = 0

            def flush(id_, tkey):
                starts = np.concatenate([[0], np.cumsum([len(p[2]) for p in held])[:-1]]).astype(np.int64)
                s = sampler(np.concatenate([p[2] for p in held]), np.concatenate([p[3] for p in held]), starts)
                bands = np.zeros((BANDS, len(held)), U64)
                with np.errstate(over="ignore"):
                    for j in range(BANDS):
                        for x in s[j * ROWS:(j + 1) * ROWS]:
                            bands[j] = mixed(bands[j] * U64(0x9E3779B97F4A7C15) + x)
                flat = np.ascontiguousarray(bands.T).view(np.int64).reshape(-1)
                sketch = np.ascontiguousarray(mixed(s).T.astype("<u4"))
                take = pa.array([p[0] for p in held], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [id_.take(take), tkey.take(take), pa.array([p[1] for p in held], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * BANDS, pa.int32()), pa.array(flat)),
                     pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["id", "tkey", "digest", "bands", "sketch"])

            for i, text in enumerate(b.column("text")):
                w = words(text.as_py() or b"")
                if not len(w):
                    continue
                h, weight = shingles(w, weights)
                held.append((i, xxhash.xxh3_128_digest(w.tobytes()), h, levels(weight)))
                size += len(h)
                if size > CHUNK:
                    yield flush(b.column("id"), b.column("tkey"))
                    held, size = [], 0
            if held:
                yield flush(b.column("id"), b.column("tkey"))

    return written(rows.select("id", "tkey", "text").mapInArrow(
        sign, "id long, tkey binary, digest binary, bands array<long>, sketch binary"), "near-signatures")


def members(signed: DataFrame, *columns: str) -> DataFrame:
    """Each node in its BANDS buckets, with the share of the bucket it falls in."""
    share = F.pmod(F.xxhash64("id", "band"), F.lit(SHARES)).cast("int")
    return signed.select("id", *columns, F.posexplode("bands").alias("band", "key")).withColumn("share", share)


def candidates(signed: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes that share a band, at most 2 x BANDS for a text."""
    rows = members(signed)
    # least members by partial aggregates, however many share a key
    shares = rows.groupBy("band", "key", "share").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = shares.groupBy("band", "key").agg(F.min("least").alias("all_least"), F.sum("n").alias("n")).filter("n > 1")
    near = shares.drop("n").join(least.drop("n").hint("merge"), ["band", "key"])
    rows = rows.join(near.hint("merge"), ["band", "key", "share"])
    pairs = rows.select(F.explode(F.array(
        F.struct(F.col("all_least").alias("a"), F.col("id").alias("b")),
        F.struct(F.col("least").alias("a"), F.col("id").alias("b")))).alias("p")).select("p.*")
    return pairs.filter("a < b").distinct()


def open_buckets(signed: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of three and more whose members are of several classes in ``found``: id, class, band, key, groups."""
    classed = signed.join(found.withColumnRenamed("id", "_id").hint("merge"), F.col("id") == F.col("_id"), "left") \
        .select("id", "bands", F.coalesce("class", "id").alias("class"))
    rows = members(classed, "class")
    shares = rows.groupBy("band", "key", "share").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    whole = shares.groupBy("band", "key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # a bucket of two has been compared with its least member
    open_ = whole.filter("n > 2 and low <> high").select(
        "band", "key", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
    here = shares.select("band", "key", "share").join(open_.hint("merge"), ["band", "key"])
    return written(rows.join(here.hint("merge"), ["band", "key", "share"]).drop("share"), "near-open")


def cell_links(ids: np.ndarray, classes: np.ndarray, mine: np.ndarray, lo: int, hi: int, band: int, sketch: np.ndarray,
               texts: list[bytes], words: Words, idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Verified links that join classes within a cell: members of group ``lo`` with those of group ``hi``."""
    left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    one, two, agree = [], [], []
    for at in range(0, len(left), 64):
        some = left[at:at + 64]
        same = sketch[some][:, None, :] == sketch[right][None, :, :]
        count = same.sum(2)
        good = (count >= AGREE) & (classes[some][:, None] != classes[right][None, :])
        # once a pair: in the first band it shares
        good &= ~same.reshape(*same.shape[:2], BANDS, ROWS).all(3)[:, :, :band].any(2)
        if lo == hi:
            good &= ids[some][:, None] < ids[right][None, :]
        i, j = np.nonzero(good)
        one.append(some[i])
        two.append(right[j])
        agree.append(count[i, j])
    one, two, agree = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two, agree))
    bags: dict[int, tuple] = {}

    def bag(i: int) -> tuple:
        if i not in bags:
            bags[i] = shingles(words(texts[i]), idf)
        return bags[i]

    if len(one) > PIVOTS * len(ids):                     # distances to a few members rule most pairs out
        pivots = np.unique(classes, return_index=True)[1][:PIVOTS]
        for p in pivots.tolist():
            far = np.array([1 - similarity(bag(i), bag(p)) for i in range(len(ids))])
            near = np.abs(far[one] - far[two]) <= 1 - threshold + 1e-9
            one, two, agree = one[near], two[near], agree[near]
    parent = {c: c for c in classes.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for k in np.argsort(-agree, kind="stable").tolist():
        i, j = int(one[k]), int(two[k])
        a, b = root(int(classes[i])), root(int(classes[j]))
        if a != b and similarity(bag(i), bag(j)) >= threshold:
            parent[max(a, b)] = min(a, b)
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def within(opened: DataFrame, nodes: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links between classes inside the open buckets."""
    # a member goes to the cells of its group with every group of the bucket
    mine = F.pmod(F.xxhash64("key", "id"), F.col("groups")).cast("int")
    rows = opened.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.select("id", "class", "band", "key", "mine", F.least("mine", "other").alias("lo"),
                       F.greatest("mine", "other").alias("hi"))
    held = nodes.select("id", "sketch").join(texts.hint("merge"), "id")
    cells = rows.join(held.hint("merge"), "id").repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = Words(), idf.value
        held: list[pa.Table] = []                            # the rows of the cell that may go on

        def starts(t: pa.Table) -> np.ndarray:
            cell = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "lo", "hi")])
            return np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1])

        def links_of(t: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            col = {c: t.column(c).to_numpy() for c in ("id", "class", "mine", "lo", "hi", "band")}
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u4").reshape(-1, BANDS * ROWS)
            found = []
            for s, e in zip(first[:-1], first[1:], strict=True):
                if e - s > 1:
                    found += cell_links(col["id"][s:e], col["class"][s:e], col["mine"][s:e], col["lo"][s], col["hi"][s],
                                        int(col["band"][s]), sketch[s:e], t.column("text").slice(s, e - s).to_pylist(), words,
                                        weights, threshold)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                               pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            first = starts(t)
            if len(first) > 1:
                yield links_of(t.slice(0, first[-1]), first)
            held = [t.slice(first[-1])]
        if held:
            yield links_of(held[0], np.array([0, held[0].num_rows]))

    return cells.mapInArrow(run, "a long, b long")


def texts_of(rows: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """id (of a node), text (as bytes): one text of each node in ``needed``."""
    wanted = nodes.join(needed.hint("merge"), "id", "left_semi").select(
        "id", F.col("tkey").alias("_tkey"), F.coalesce("first", F.lit(0)).alias("_first"), F.col("first").isNull().alias("_none"))
    own = rows.select("text", "tkey", F.coalesce("id", F.lit(0)).alias("_own"), F.col("id").isNull().alias("_bare"))
    on = (F.col("tkey") == F.col("_tkey")) & (F.col("_own") == F.col("_first")) & (F.col("_bare") == F.col("_none"))
    return own.join(wanted.hint("merge"), on).select("id", "text").dropDuplicates(["id"])


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose texts are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = Words(), idf.value
        for batch in batches:
            ok, kept = [], (None, None)
            for i, (ta, tb) in enumerate(zip(batch.column("text_a"), batch.column("text_b"), strict=True)):
                a, b = ta.as_py(), tb.as_py()
                if kept[0] != b:                            # rows come in runs of one text
                    kept = (b, shingles(words(b), weights))
                if similarity(shingles(words(a), weights), kept[1]) >= threshold:
                    ok.append(i)
            take = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    # both sides grow with the corpus: shuffled alike at every size, and hot texts split by the skew join
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = written(texts_of(rows, nodes, needed), "near-texts").hint("merge")
    half = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = half.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, class: the least id of its connected component, for every id with a link.

    Each round takes the least label around and then the label of that label; tables of each round are
    written to the shared folder, so a lost executor costs one round.
    """
    edges = written(links.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct(), "near-edges")
    labels = written(edges.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("class")), "near-labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("other"), "class"), "other") \
            .groupBy("id").agg(F.min("class").alias("near"))
        new = labels.join(around, "id").select("id", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("id").alias("class"), F.col("class").alias("further"))
        new = new.join(jump, "class").select("id", "old", F.least("class", "further").alias("class"))
        new = written(new, "near-labels")
        if new.filter("old <> class").isEmpty():
            return new.select("id", "class")
        labels = new.select("id", "class")


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each (doc_id, text) that has a word, as often as it occurs: id, tkey, class (a number), n_links."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("tkey"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    idf = spark.sparkContext.broadcast(word_idf(rows))
    signed = signatures(rows, idf)
    # equal word sequences become one node; written, so that its number stays
    one = signed.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey")).alias("one"),
                                       F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(one.select("digest", F.col("one.id").alias("first"), F.col("one.tkey").alias("tkey"), "bands", "sketch",
                               F.monotonically_increasing_id().alias("id")), "near-nodes")
    pairs = written(candidates(nodes.select("id", "bands")), "near-pairs")
    links = written(verified(pairs, rows, nodes, idf, threshold).distinct(), "near-links")
    comp = components(links)
    opened = open_buckets(nodes.select("id", "bands"), comp)
    if not opened.isEmpty():
        texts = texts_of(rows, nodes, opened.select("id").distinct())
        more = written(within(opened, nodes, texts, idf, threshold).distinct(), "near-links")
        links = links.unionByName(more)
        comp = components(links)
    count = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("digest", "id").join(comp, "id", "left").join(count, "id", "left").select(
        F.col("digest").alias("of"), F.coalesce("class", "id").alias("class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return signed.select("id", "tkey", "digest").join(named, F.col("digest") == F.col("of")).select(
        "id", "tkey", "class", "n_links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, tkey, class (its least doc_id), n_links for every distinct (doc_id, text) that has a word; n_links counts verified
    links between different texts."""
    found = written(classified(docs, id_col, text_col, threshold), "near-classes")
    name = found.groupBy("class").agg(F.min("id").alias("name"))
    rows = found.distinct().join(name.withColumnRenamed("class", "_class"), F.col("class") == F.col("_class"))
    return rows.select("id", "tkey", F.col("name").alias("class"), "n_links")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class: the least doc_id (a null one last), of its rows one.  Rows without a word all stay."""
    found = written(classified(docs, id_col, text_col), "near-classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey")).alias("one"))
    best = best.select(F.col("one.none").alias("_none"), F.coalesce("one.id", F.lit(0)).alias("_id"), F.col("one.tkey").alias("_tkey"))
    text, own = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), own.isNull().alias("_none"),
                        F.coalesce(own, F.lit(0)).alias("_id"), text_key(F.col(f"`{text_col}`")).alias("_tkey"),
                        text.rlike(r"[^\x20\x09-\x0D]").alias("_word"))
    keys = ["_none", "_id", "_tkey"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    stay = whole.filter("_word").join(best.hint("merge"), keys, "left_semi").withColumn("_n", first).filter("_n = 1")
    return whole.filter("not _word").select("doc.*").unionByName(stay.select("doc.*"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = classes(docs).select(F.coalesce("id", F.lit(0)).alias("_id"), F.col("id").isNull().alias("_none"), "tkey", "class", "n_links")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                       F.col("doc_id").isNull().alias("_none"), text_key(F.col("text")).alias("tkey"))
    return rows.join(found, ["_id", "_none", "tkey"], "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
