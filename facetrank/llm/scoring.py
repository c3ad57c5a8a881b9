"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts up to ORDER bytes holds how often each byte followed each context in the
training texts.  A byte is predicted in its longest known context: with n symbols seen in all, d of
them distinct, a symbol seen c times has probability c / (n + d) and the escape d / (n + d) (method C).
After an escape the next shorter context predicts, without the symbols of the context escaped from
(exclusion): they would have been coded there.  Below order 0 the bytes not yet excluded are equally
likely.  A text starts after START bytes and ends with an END byte, neither of which occurs in UTF-8.

The trie covers all training texts and grows with them, so no task holds it.  Texts are dealt to batches by
id.  A batch sends its distinct (context, byte) grams with their training counts to buckets keyed by the last
two context bytes; a bucket therefore holds all contexts of order 2 and up that end in them, works out the
probability of every gram asked for, and answers each batch.  Orders 0 and 1 are at most 65,536 counts and
go with the function.  Word counts for the base score take the same way, by a hash of the word.

Edge cases: a null text is empty: one end token, one END byte; without training texts every byte is
equally likely and the base score divides by V + 1 = 1; a null doc_id is not held out; rows that
repeat a doc_id get a result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ready, shuffle_partitions, written

ORDER = 4
START, END = 0xFE, 0xFF
END_WORD = b""      # no word is empty, so the end token counts under the empty one
CHUNK = 1 << 21     # bytes of text worked on at once
PER_PARTITION = 1   # batches and buckets for each shuffle partition


def grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """One key per byte and the end: its ``order`` preceding bytes and itself, the byte lowest."""
    b = np.frombuffer(bytes([START]) * order + raw + bytes([END]), dtype=np.uint8).astype(np.uint64)
    key = np.zeros(len(raw) + 1, dtype=np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | b[j:j + len(key)]
    return key


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts (or sums of weights)."""
    if weights is None:
        k = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        return k[at], np.diff(np.concatenate([at, [len(k)]]))
    by = np.argsort(keys, kind="stable")
    k, w = keys[by], weights[by]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[at], (np.add.reduceat(w, at) if len(k) else w)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing=0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def gram_scores(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: np.ndarray,
                order: int = ORDER) -> np.ndarray:
    """log10 probability of each wanted gram.

    ``keys``/``counts``: the training grams of full order that share the wanted ones' last two context bytes;
    ``low``: a 256 x 256 table of counts of (byte, next byte) over all training texts.
    """
    u64 = np.uint64
    # tables[o]: grams of order o, their counts, distinct contexts with total, distinct symbols
    tables = {}
    k, c = keys[counts > 0], counts[counts > 0].astype(np.int64)
    for o in range(order, 1, -1):
        k, c = counted(k & u64((1 << (8 * (o + 1))) - 1), c)
        tables[o] = (k, c)
    if order >= 1:
        a = np.arange(65_536, dtype=u64)
        flat = low.reshape(-1).astype(np.int64)
        tables[1] = (a[flat > 0], flat[flat > 0])
    zero = low.sum(0).astype(np.int64)
    tables[0] = (np.flatnonzero(zero).astype(u64), zero[zero > 0])

    out = np.zeros(len(wanted))
    todo = np.arange(len(wanted))
    ctx_above = None                       # (contexts of the order above, distinct symbols, counts here of these symbols)
    for o in range(order, -1, -1):
        k, c = tables[o]
        ctx = k >> u64(8)
        ctxs, total = counted(ctx, c)
        _, distinct = counted(ctx)
        w = wanted[todo] & u64((1 << (8 * (o + 1))) - 1)
        wc = w >> u64(8)
        n = lookup(ctxs, total, wc).astype(float)
        d = lookup(ctxs, distinct, wc).astype(float)
        hit = lookup(k, c, w).astype(float)
        if ctx_above is not None:          # take out what the order above has excluded
            a_ctx, a_n, a_sum = ctx_above
            above = wanted[todo] >> u64(8) & u64((1 << (8 * (o + 1))) - 1)
            d = d - lookup(a_ctx, a_n, above)
            n = n - lookup(a_ctx, a_sum, above)
        known = d > 0                      # otherwise the context has nothing new to offer: pass on for free
        seen = known & (hit > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[todo] += np.where(known, np.log10(np.where(seen, hit, d)) - np.log10(n + d), 0.0)
        # symbols of each context of this order, with their counts one order below
        if o:
            k2, c2 = tables[o - 1]
            below = lookup(k2, c2, k & u64((1 << (8 * o)) - 1))
            if len(k):
                ctx_above = (ctxs, distinct, np.add.reduceat(below, np.searchsorted(ctx, ctxs)))
            else:
                ctx_above = (ctxs, distinct, below)
        todo = todo[~seen]
        if not len(todo):
            return out
    out[todo] -= np.log10(256 - len(tables[0][0]))
    return out


def _press(*arrays: np.ndarray) -> bytes:
    import zstandard
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _loosen(blob: bytes) -> bytes:
    import zstandard
    return zstandard.decompress(blob)


def _texts(table: pa.Table):
    """The texts' bytes, A-Z in lower case.  ``bytes.split()`` then cuts at exactly the six blanks of a word."""
    for x in table.column("text"):
        yield (x.as_py() or "").encode("utf-8", "replace").lower()


def _distinct(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Distinct grams and words of a batch with their training counts, both in a fixed order."""
    parts, held = [], np.asarray(table.column("held_out"))
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    todo: dict[bool, list] = {True: [], False: []}
    size = 0

    def flush():
        for h, some in todo.items():
            if some:
                k, c = counted(np.concatenate(some))
                parts.append((k, np.zeros_like(c) if h else c))
        todo[True], todo[False] = [], []

    for text, h in zip(_texts(table), held.tolist(), strict=True):
        g = grams(text, order)
        todo[h].append(g)
        size += len(g)
        w = words[h]
        w.update(text.split())
        w[END_WORD] += 1
        if size > CHUNK:
            flush()
            size = 0
    flush()
    keys, counts = counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])) if parts else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64))
    names = sorted(set(words[True]) | set(words[False]))
    return keys, counts, names, np.array([words[False][x] for x in names], dtype=np.int64)


def _by_bucket(bucket: np.ndarray):
    """(bucket, indices) of each bucket."""
    by = np.argsort(bucket, kind="stable")
    b = bucket[by]
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for lo, hi in zip(at, [*at[1:], len(b)], strict=True):
        yield int(b[lo]), by[lo:hi]


def model_tables(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """What batches ask of buckets: kind (g: grams, w: words, l: pairs), bucket, batch, message.  Written once."""
    spark = rows.sparkSession
    buckets = PER_PARTITION * shuffle_partitions(spark)

    def ask(key, table):
        import xxhash
        keys, counts, names, word_counts = _distinct(table, order)
        kind, bucket, message = [], [], []
        context = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
        for b, i in _by_bucket(((context * np.uint64(40503)) % np.uint64(buckets)).astype(np.int64)):
            kind.append("g")
            bucket.append(b)
            k = keys[i]
            message.append(_press(np.array([len(k)], "<i8"), np.diff(k, prepend=np.uint64(0)).astype("<u8"),
                                  counts[i].astype("<u4")))
        h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), dtype=np.uint64, count=len(names))
        for b, i in _by_bucket((h % np.uint64(buckets)).astype(np.int64)):
            kind.append("w")
            bucket.append(b)
            blob = b"\n".join([names[j] for j in i.tolist()])
            message.append(_press(np.array([len(i)], "<i8"), word_counts[i].astype("<u4"), np.frombuffer(blob, np.uint8)))
        k, c = counted(keys[counts > 0] & np.uint64(0xFFFF), counts[counts > 0])
        kind.append("l")
        bucket.append(-1)
        message.append(_press(np.array([len(k)], "<i8"), k.astype("<u2"), c.astype("<i8")))
        return pa.table([pa.array(kind, pa.string()), pa.array(bucket, pa.int32()),
                         pa.array([key[0].as_py()] * len(kind), pa.int32()), pa.array(message, pa.binary())],
                        names=["kind", "bucket", "batch", "message"])

    return written(rows.groupBy("batch").applyInArrow(ask, "kind string, bucket int, batch int, message binary"),
                   "lm-asked")


def _pairs(asked: DataFrame) -> np.ndarray:
    """The table of (byte, next byte) counts: at most 65,536 numbers reach the driver."""
    def spread(batches):
        for b in batches:
            keys, counts = [], []
            for m in b.column("message"):
                raw = _loosen(m.as_py())
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                keys.append(np.frombuffer(raw, "<u2", n, 8))
                counts.append(np.frombuffer(raw, "<i8", n, 8 + 2 * n))
            k, c = counted(np.concatenate(keys).astype(np.uint64), np.concatenate(counts)) if keys else (
                np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], names=["pair", "n"])

    out = np.zeros(65_536, dtype=np.int64)
    for r in asked.filter("kind = 'l'").select("message").mapInArrow(spread, "pair int, n long") \
            .groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256)


def answers(asked: DataFrame, low: np.ndarray, order: int = ORDER) -> DataFrame:
    """Each bucket's answers: kind, batch, message, and for words the totals of the bucket."""
    shared = asked.sparkSession.sparkContext.broadcast(low)

    def settle(key, table):
        batches, messages = table.column("batch").to_pylist(), [_loosen(m.as_py()) for m in table.column("message")]
        n = [int(np.frombuffer(m, "<i8", 1)[0]) for m in messages]
        out, total, distinct = [], 0, 0
        if key[0].as_py() == "g":
            keys = [np.cumsum(np.frombuffer(m, "<u8", x, 8)) for m, x in zip(messages, n, strict=True)]
            counts = [np.frombuffer(m, "<u4", x, 8 + 8 * x).astype(np.int64) for m, x in zip(messages, n, strict=True)]
            k, c = counted(np.concatenate(keys), np.concatenate(counts))
            score = gram_scores(k, k, c, shared.value, order)
            for own in keys:
                out.append(_press(np.array([len(own)], "<i8"), np.diff(own, prepend=np.uint64(0)).astype("<u8"),
                                  score[np.searchsorted(k, own)]))
        else:
            words = [m[8 + 4 * x:].split(b"\n") for m, x in zip(messages, n, strict=True)]
            counts = [np.frombuffer(m, "<u4", x, 8) for m, x in zip(messages, n, strict=True)]
            sums: Counter = Counter()
            for w, c in zip(words, counts, strict=True):
                for x, y in zip(w, c.tolist(), strict=True):
                    sums[x] += y
            total, distinct = sum(sums.values()), sum(1 for v in sums.values() if v)
            for w in words:
                blob = b"\n".join(w)
                out.append(_press(np.array([len(w)], "<i8"), np.array([sums[x] for x in w], dtype="<i8"),
                                  np.frombuffer(blob, np.uint8)))
        first = [1] + [0] * (len(out) - 1)
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(batches, pa.int32()),
                         pa.array(out, pa.binary()), pa.array([total * f for f in first], pa.int64()),
                         pa.array([distinct * f for f in first], pa.int64())],
                        names=["kind", "batch", "message", "total", "distinct"])

    return written(asked.filter("kind <> 'l'").groupBy("kind", "bucket").applyInArrow(
        settle, "kind string, batch int, message binary, total long, distinct long"), "lm-answers")


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
           order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ready(spark)
    batches = PER_PARTITION * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int").alias("batch"))
    asked = model_tables(rows, order)
    answered = answers(asked, _pairs(asked), order)
    sums = answered.agg(F.sum("total"), F.sum("distinct")).first()
    tokens, vocabulary = sums[0] or 0, sums[1] or 0
    floor = np.log10(tokens + 0.1 * (vocabulary + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right.column("kind").to_pylist()
        keys, logs, known = [], [], {}
        for kind, m in zip(kinds, right.column("message"), strict=True):
            raw = _loosen(m.as_py())
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            if kind == "g":
                keys.append(np.cumsum(np.frombuffer(raw, "<u8", n, 8)))
                logs.append(np.frombuffer(raw, "<f8", n, 8 + 8 * n))
            else:
                known.update(zip(raw[8 + 8 * n:].split(b"\n"), np.log10(np.frombuffer(raw, "<i8", n, 8) + 0.1).tolist(), strict=True))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        by = np.argsort(key)
        key, log = key[by], (np.concatenate(logs)[by] if logs else np.zeros(0))
        out = {"n": [], "k": [], "base": [], "score": []}
        for text in _texts(left):
            words = text.split()
            words.append(END_WORD)
            logs = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
            k, c = counted(grams(text, order))       # distinct grams in order: lookups stay close together
            out["n"].append(len(words))
            out["k"].append(int((logs > 0).sum()))   # log10(c + 0.1) is above 0 from c = 1 on
            out["base"].append(float(logs.sum() - len(words) * floor))
            out["score"].append(float((log[np.searchsorted(key, k)] * c).sum()))
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(out["n"], pa.int64()),
                         pa.array(out["k"], pa.int64()), pa.array(np.full(len(out["n"]), tokens, dtype=np.int64)),
                         pa.array(out["base"], pa.float64()), pa.array(out["score"], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.groupBy("batch").cogroup(answered.select("kind", "message", "batch").groupBy("batch")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def op9_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), held_out())
