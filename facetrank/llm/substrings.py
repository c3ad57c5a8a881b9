"""Removal of repeated word windows, by super-k-mers.

A window is K consecutive words.  Its minimiser is the least hash among its M-word grams.
Consecutive windows that share a minimiser travel as one packed string of words, a super-k-mer, to the
bucket of that minimiser; equal windows have equal minimisers, so they meet there.  A bucket sorts its
windows by a hash of their words, puts the words of equal hashes side by side, and so finds exactly
which windows start earlier elsewhere.

Documents are dealt to batches by id, once; the three passes over them read that same exchange.
1. A batch sends its distinct minimisers to their buckets and learns which occur anywhere else.  A
   super-k-mer whose minimiser occurs once in the corpus holds no repeated window and stays at home.
2. The others travel.  Before that, a batch finds repeats among its own windows; only its earliest copy of
   a window travels, the others are marked on the spot.  So a passage that a third of all documents
   share reaches its bucket once per batch, not once per document.
3. The marked word ranges go back to the batches, which cut them out.

All that travels between a batch and a bucket is one compressed message: the distinct words, the
super-k-mers as numbers of these words, their places, and the places already marked.

A place is (doc_id, start), compared as numbers.  Equal doc_ids with different texts are told apart by a hash
of the text; rows equal in both are one document, so none is the earlier one.

Edge cases: a null text has no words; a null doc_id counts as the smallest; texts under K words keep all;
repeated rows each get the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ready, shuffle_partitions

K = 20             # words of a window
M = 3              # words of a minimiser's gram
PER_PARTITION = 2  # batches and buckets for each shuffle partition: a task holds one at a time
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NULL_ID = -(2 ** 63)
MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, by doubling; the last n - 1 places are cut off."""
    have, out, rest = 1, h, n
    acc, acc_n = None, 0
    power = MULT
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if acc is None:
                    acc, acc_n = out, have
                else:
                    m = len(out) - acc_n
                    acc = mixed(acc[:max(0, m)] * power + out[acc_n:]) if m > 0 else out[:0]
                    acc_n += have
            rest >>= 1
            if rest:
                m = len(out) - have
                out = mixed(out[:max(0, m)] * (power + np.uint64(2 * have)) + out[have:]) if m > 0 else out[:0]
                have *= 2
    return acc[:max(0, len(h) - n + 1)]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have, out = 1, x
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    d = n - have
    return np.minimum(out[:len(out) - d], out[d:]) if d else out


def not_first(hashes: np.ndarray, at: np.ndarray, words: np.ndarray, doc: np.ndarray, key: np.ndarray,
              start: np.ndarray) -> np.ndarray:
    """For windows at ``words[at:at + K]``: True where an equal window has a smaller (doc, key, start).

    Windows are sorted by hash; words of equal hashes are compared, so the answer is exact.
    """
    out = np.zeros(len(at), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return out
    near = np.zeros(len(h), dtype=bool)
    near[1:] |= same
    near[:-1] |= same
    idx = order[near]                                    # windows that share their hash with another
    group = np.cumsum(np.concatenate([[True], hashes[idx][1:] != hashes[idx][:-1]]))
    by = np.lexsort((start[idx], key[idx], doc[idx], group))
    idx, group = idx[by], group[by]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(idx)), 0))
    equal = np.ones(len(idx), dtype=bool)
    for c in range(0, len(idx), 200_000):                # words of each window against its group's first
        s = slice(c, c + 200_000)
        span = np.arange(K)
        equal[s] = (words[at[idx[s], None] + span] == words[at[idx[first[s]], None] + span]).all(1)
    later = (doc[idx] != doc[idx[first]]) | (key[idx] != key[idx[first]]) | (start[idx] != start[idx[first]])
    out[idx[equal & later]] = True
    if not equal.all():                                  # different words of one hash: compare by the words
        seen: dict[bytes, tuple] = {}
        for g in np.unique(group[~equal]):
            seen.clear()
            for i in idx[group == g]:
                w, place = words[at[i]:at[i] + K].tobytes(), (doc[i], key[i], start[i])
                out[i] = seen.setdefault(w, place) != place
    return out


def runs(marked: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (doc, key, first word, end word) covering the marked windows, consecutive windows joined."""
    i = np.flatnonzero(marked)
    if not len(i):
        return np.zeros((0, 4), dtype=np.int64)
    by = np.lexsort((start[i], key[i], doc[i]))
    i = i[by]
    d, k, s = doc[i], key[i], start[i]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] > s[:-1] + K)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(i)]]) - 1
    return np.stack([d[first], k[first], s[first], s[last] + K], axis=1)


def packed(words: list[str], ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, marks: np.ndarray) -> bytes:
    import zstandard
    blob = "\n".join(words).encode()
    head = np.array([len(blob), len(words), len(ids), len(sizes), len(marks)], dtype="<i8")
    kind = "<u2" if len(words) < 65_536 else "<u4"
    return zstandard.compress(head.tobytes() + blob + ids.astype(kind).tobytes() + sizes.astype("<u4").tobytes()
                              + places.astype("<i8").T.tobytes() + marks.astype("<i8").T.tobytes(), 1)


def unpacked(message: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard
    b = zstandard.decompress(message)
    n_blob, n_words, n_ids, n_sizes, n_marks = np.frombuffer(b, "<i8", 5).tolist()
    at = 40
    words = b[at:at + n_blob].decode().split("\n") if n_words else []
    at += n_blob
    kind = "<u2" if n_words < 65_536 else "<u4"
    ids = np.frombuffer(b, kind, n_ids, at).astype(np.int64)
    at += n_ids * (2 if kind == "<u2" else 4)
    sizes = np.frombuffer(b, "<u4", n_sizes, at).astype(np.int64)
    at += n_sizes * 4
    places = np.frombuffer(b, "<i8", n_sizes * 3, at).reshape(3, -1).T
    at += n_sizes * 24
    return words, ids, sizes, places, np.frombuffer(b, "<i8", n_marks * 4, at).reshape(4, -1).T


class Batch:
    """Words, windows and minimisers of the texts of a batch, rows (doc, key, text)."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        import xxhash
        number: dict[str, int] = {}
        names: list[str] = []
        parts = []
        for _, _, text in rows:
            w = WORD.findall(text)
            for x in set(w):
                if x not in number:
                    number[x] = len(names)
                    names.append(x)
            parts.append(np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w)))
        self.names = names
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n = np.array([len(w) for w in parts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(self.words)) - first[row]
        self.at = np.flatnonzero(pos <= (n - K)[row])                # where windows begin
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), dtype=np.uint64, count=len(names))
        self.hashes = hashes[self.words]
        self.grams = gram_hashes(self.hashes, M) if len(self.at) else np.zeros(0, np.uint64)
        self.least = sliding_min(self.grams, K - M + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        of = row[self.at]
        self.doc = np.array([r[0] for r in rows], dtype=np.int64)[of]
        self.key = np.array([r[1] for r in rows], dtype=np.int64)[of]
        self.start = pos[self.at]

    def runs_of(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Super-k-mers among the windows ``keep``: where each begins in ``keep``, and its number of windows."""
        a, m = self.at[keep], self.least[keep]
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1] + 1) | (m[1:] != m[:-1])]))
        return head, np.diff(np.concatenate([head, [len(a)]]))

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimisers, and whether the batch itself holds each more than once."""
        every = np.arange(len(self.at))
        head, size = self.runs_of(every)
        if not len(head):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        value = self.least[head]
        # a minimiser may also repeat inside one super-k-mer, as in a text that goes round in circles
        span = size + K - M
        inside = np.repeat(self.at[head] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        times = np.add.reduceat(self.grams[inside] == np.repeat(value, span), np.concatenate([[0], np.cumsum(span)[:-1]]),
                                dtype=np.int64)
        by = np.argsort(value, kind="stable")
        value, times = value[by], times[by]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        return value[first], np.add.reduceat(times, first) > 1

    def messages(self, repeated: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
        """(bucket, message) of the super-k-mers whose minimisers are among ``repeated`` (sorted)."""
        if not len(repeated) or not len(self.at):
            return []
        near = np.minimum(np.searchsorted(repeated, self.least), len(repeated) - 1)
        mine = np.flatnonzero(repeated[near] == self.least)
        if not len(mine):
            return []
        at, doc, key, start = self.at[mine], self.doc[mine], self.key[mine], self.start[mine]
        marked = not_first(gram_hashes(self.hashes, K)[at], at, self.words, doc, key, start)
        marks = runs(marked, doc, key, start)
        keep = mine[~marked]
        head, size = self.runs_of(keep)
        bucket = (self.least[keep[head]] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        head, size, bucket = head[by], size[by], bucket[by]
        mark_bucket = marks[:, 0] % buckets
        out = []
        for b in sorted(set(bucket.tolist()) | set(mark_bucket.tolist())):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            h, count = keep[head[lo:hi]], size[lo:hi] + K - 1
            ids = self.words[np.repeat(self.at[h] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count)
                             + np.arange(count.sum())] if len(h) else np.zeros(0, np.int64)
            used, local = np.unique(ids, return_inverse=True)
            places = np.stack([self.doc[h], self.key[h], self.start[h]], axis=1).reshape(-1, 3)
            out.append((b, packed([self.names[i] for i in used.tolist()], local, count, places, marks[mark_bucket == b])))
        return out


def resolved(blobs: list[bytes]) -> np.ndarray:
    """Rows (doc, key, first word, end word) to remove, of one bucket."""
    import xxhash
    number: dict[str, int] = {}
    ids, sizes, places, marks = [], [], [], []
    for blob in blobs:
        w, i, s, p, m = unpacked(blob)
        own = np.fromiter((number.setdefault(x, len(number)) for x in w), dtype=np.int64, count=len(w))
        ids.append(own[i].astype(np.int32))
        sizes.append(s)
        places.append(p)
        marks.append(m)
    words, size, place, out = (np.concatenate(x) for x in (ids, sizes, places, marks))
    if not len(size):
        return out
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in number), dtype=np.uint64, count=len(number))
    count = size - (K - 1)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    step = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = np.repeat(first, count) + step
    doc, key = np.repeat(place[:, 0], count), np.repeat(place[:, 1], count)
    start = np.repeat(place[:, 2], count) + step
    marked = not_first(gram_hashes(hashes[words], K)[at], at, words, doc, key, start)
    return np.concatenate([out, runs(marked, doc, key, start)])


def _rows(table: pa.Table) -> list[tuple[int, int, str]]:
    return list(zip(table.column("doc").to_pylist(), table.column("key").to_pylist(),
                    [t or "" for t in table.column("text").to_pylist()], strict=True))


def _squeezed(values: np.ndarray, flags: np.ndarray) -> bytes:
    import zstandard
    return zstandard.compress(np.array([len(values)], "<i8").tobytes() + np.diff(values, prepend=np.uint64(0)).astype("<u8").tobytes()
                              + np.packbits(flags).tobytes(), 1)


def _expanded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    b = zstandard.decompress(blob)
    n = int(np.frombuffer(b, "<i8", 1)[0])
    return (np.cumsum(np.frombuffer(b, "<u8", n, 8)).astype(np.uint64),
            np.unpackbits(np.frombuffer(b, np.uint8, -1, 8 + 8 * n), count=n).astype(bool))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one blank) of every row."""
    spark = docs.sparkSession
    ready(spark)
    n = PER_PARTITION * shuffle_partitions(spark)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = docs.select(F.col(id_col).alias("doc_id"), doc.alias("doc"), F.xxhash64(F.col(text_col)).alias("key"),
                       F.col(text_col).alias("text"), F.pmod(F.xxhash64(doc), F.lit(n)).cast("int").alias("batch"))

    def sent(batch, found: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([batch] * len(found), pa.int32()),
                         pa.array([m for _, m in found], pa.binary())], names=["bucket", "batch", "message"])

    def ask(table: pa.Table) -> pa.Table:
        values, twice = Batch(_rows(table)).minimisers()
        bucket = (values % np.uint64(n)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")       # values stay sorted inside a bucket
        cuts = np.searchsorted(bucket[by], np.arange(n + 1))
        return sent(table.column("batch")[0].as_py(), [
            (b, _squeezed(values[by[cuts[b]:cuts[b + 1]]], twice[by[cuts[b]:cuts[b + 1]]]))
            for b in range(n) if cuts[b] < cuts[b + 1]])

    def answer(table: pa.Table) -> pa.Table:
        got = [_expanded(m) for m in table.column("message").to_pylist()]
        value = np.concatenate([v for v, _ in got])
        times = np.concatenate([1 + f.astype(np.int64) for _, f in got])
        by = np.argsort(value, kind="stable")
        value, times = value[by], times[by]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        repeated = value[first][np.add.reduceat(times, first) > 1]
        batches, out = table.column("batch").to_pylist(), []
        for batch, (v, _) in zip(batches, got, strict=True):
            own = v[np.isin(v, repeated, assume_unique=True)]
            if len(own):
                out.append((batch, _squeezed(own, np.ones(len(own), bool))))
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())],
                        names=["batch", "message"])

    def travel(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = [_expanded(m)[0] for m in right.column("message").to_pylist()]
        if not wanted or not left.num_rows:
            return sent(0, [])
        return sent(left.column("batch")[0].as_py(), Batch(_rows(left)).messages(np.sort(np.concatenate(wanted)), n))

    def settle(table: pa.Table) -> pa.Table:
        out = resolved(table.column("message").to_pylist())
        return pa.table([pa.array(out[:, c]) for c in range(4)], names=["doc", "key", "first", "end"])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list] = {}
        for d, k, a, b in zip(*[right.column(c).to_pylist() for c in ("doc", "key", "first", "end")], strict=True):
            gone.setdefault((d, k), []).append((a, b))
        n_words, n_removed, kept = [], [], []
        for d, k, text in _rows(left):
            words = WORD.findall(text)
            cover = gone.get((d, k))
            n_words.append(len(words))
            if cover:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, [a for a, _ in cover], 1)
                np.add.at(edge, [b for _, b in cover], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(" ".join(words))
        return pa.table([left.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    asked = rows.groupBy("batch").applyInArrow(ask, "bucket int, batch int, message binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "batch int, message binary")
    moved = rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        travel, "bucket int, batch int, message binary")
    spans = moved.select("bucket", "message").groupBy("bucket").applyInArrow(
        settle, "doc long, key long, first long, end long")
    spans = spans.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int"))
    kind = dict(docs.dtypes)[id_col]
    return rows.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(
        remove, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
