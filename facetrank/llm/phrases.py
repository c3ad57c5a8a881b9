"""Collocated phrases by SETM: occurrence relations, merge-joined and counted in sets.

The relation R1 holds every occurrence of a word as (position, word), sorted by position.  Positions run through
the pieces of a block with a gap of one after each piece, so a position names its piece too and two positions
in a row lie in one piece.  Round k
1. counts the groups of R(k): each block sends its distinct phrases with their counts to the bucket of each
   phrase, which sums them (so a hot phrase travels once a block);
2. sends the ids of the frequent ones, and of no others, back to the blocks that hold them;
3. drops from R(k) in each block what is not frequent (the semi-join), and merge-joins the rest with
   itself at the next position: the phrase of k words at p and the one at p + 1 make one of k + 1 words.
R(k + 1) is written, sorted by position, to the shared folder before the next round reads it.

A phrase gets its id from its bucket; a longer one is the pair of ids it is made of: exact keys, no hashes of words.
A block holds about BLOCK words (a longer text makes a longer block), however large the table.  What a block sends a
bucket is one message of sorted numbers.  A message holds at least one phrase, so there are never more messages
than there would be rows.  Everything is per language.

For every frequent phrase the counts of all its prefixes and suffixes come from the two phrases it is made of.
``score`` is floor(SCALE * a / (l + r)) of the lowest-scoring cut, in decimals of 38 digits.

Edge cases: a null text has no words, and a null lang is ``und``; two blanks or separators in a row make no word; texts,
pieces and words of any length are taken whole; repeated rows count as often as they occur; an empty table, or one
without a phrase of ``least`` occurrences, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready, shuffle_partitions, written

LEAST = 30           # occurrences of a frequent phrase
LONGEST = 4          # words of a phrase
SCALE = 2_000_000
INSIDE = 80          # a phrase goes if a longer one has this share (in hundredths) of its occurrences
TOP = 2_000
BLOCK = 1 << 20      # words of a block
UND = "und"
BLOCK_BITS = 20      # blocks of a partition
LEVEL = 5            # of compression of what is written and sent
RELATION = "block long, occurrences binary, bucket int, message binary"

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"      # no byte of UTF-8
_BREAKS = bytes.maketrans(SEPARATORS, BREAK * len(SEPARATORS))


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text in order, BREAK between pieces; A-Z in lower case.

    Once separators are replaced, blanks and tabs are all that ``split`` cuts at.
    """
    return text.lower().translate(_BREAKS).replace(BREAK, b" \xff ").split()


class _Numbers(dict):
    """Numbers of the words of one language, from 1, given out by one counter."""

    def __init__(self, counter: list[int]):
        super().__init__({BREAK: 0})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self.counter[0] += 1
        self[word] = self.counter[0]
        return self.counter[0]


def _squeezed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of one length as bytes, with what follows them.  First bytes, second bytes and so on lie together."""
    import zstandard
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(arrays[0])], "<i8").tobytes() + b"".join(planes) + tail, LEVEL)


def _opened(blob: bytes, *kinds: str) -> tuple:
    import zstandard
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return (*out, raw[at:])


def packed(pos: np.ndarray, gram: np.ndarray) -> bytes:
    """A sorted relation of (position, phrase number) as bytes."""
    return _squeezed(np.diff(pos, prepend=0).astype("<u4"), gram.astype("<u4"))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, gram, _ = _opened(blob, "<u4", "<u4")
    return np.cumsum(steps, dtype=np.int64), gram.astype(np.int64)


def next_relation(pos: np.ndarray, gram: np.ndarray, local: np.ndarray, ids: np.ndarray):
    """R(k + 1) of a block from R(k) and its frequent phrases (numbers and ids).

    Returns positions, phrase numbers from 1, and per phrase its two parts' ids (sorted) and its count.
    """
    by = np.argsort(ids)
    rank = np.zeros(int(max(gram.max(initial=0), local.max(initial=0))) + 1, dtype=np.int64)
    rank[local[by]] = np.arange(1, len(by) + 1)
    gram = rank[gram]                                   # the semi-join: 0 is not frequent
    at = np.flatnonzero((pos[1:] == pos[:-1] + 1) & (gram[1:] > 0) & (gram[:-1] > 0))
    key = gram[at] * (len(by) + 1) + gram[at + 1]       # the merge-join: the same piece, the next position
    value, number, count = np.unique(key, return_inverse=True, return_counts=True)
    ids = ids[by]
    part = lambda rank: ids[rank - 1] if len(rank) else rank
    return pos[at], number.reshape(-1) + 1, part(value // (len(by) + 1)), part(value % (len(by) + 1)), count


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    for lo, hi in zip(first, [*first[1:], len(by)], strict=True):
        yield int(bucket[by[lo]]), by[lo:hi]


def _rows(block: int, pos: np.ndarray, gram: np.ndarray, sent: list[tuple[int, bytes]]) -> dict[str, list]:
    """A block's relation and its messages as columns of RELATION."""
    return {"block": [block] * (1 + len(sent)), "occurrences": [packed(pos, gram)] + [None] * len(sent),
            "bucket": [None] + [b for b, _ in sent], "message": [None] + [m for _, m in sent]}


_RELATION = pa.schema([("block", pa.int64()), ("occurrences", pa.binary()), ("bucket", pa.int32()), ("message", pa.binary())])


_ANSWERS = pa.schema([("block", pa.int64()), ("message", pa.binary()), ("id", pa.int64()), ("f", pa.int64()), ("lang", pa.string()),
                      ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64())])


def words(rows: DataFrame, buckets: int) -> DataFrame:
    """R1 by block, and the blocks' distinct words by bucket.  Written once."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        block, counter, numbers, held, size = 0, [0], {}, [], 0

        def flush() -> pa.RecordBatch:
            if block >= 1 << BLOCK_BITS:
                raise ValueError("a partition of too many blocks: cut the input finer")
            every = np.concatenate(held)
            # numbers by falling count: the common words' have zero high bytes, which take no space
            n = np.bincount(every, minlength=counter[0] + 1)
            by = np.argsort(-n[1:], kind="stable") + 1
            rank = np.zeros(counter[0] + 1, dtype=np.int64)
            rank[by] = np.arange(1, counter[0] + 1)
            every, n = rank[every], np.concatenate([n[:1], n[by]])
            pos = np.flatnonzero(every)
            found: dict[int, tuple[list, list, list]] = {}
            names = list(numbers)
            for of, (lang, own) in enumerate(numbers.items()):
                salt = xxhash.xxh3_64_intdigest(lang)
                for word, at in own.items():
                    if at:
                        at = int(rank[at])
                        local, langs, texts = found.setdefault(xxhash.xxh3_64_intdigest(word, salt) % buckets, ([], [], []))
                        local.append(at)
                        langs.append(of)
                        texts.append(word)
            heads = [x.encode() for x in names]
            head = np.array([len(heads), *map(len, heads)], "<i8").tobytes() + b"".join(heads)
            sent = [(b, _squeezed(np.array(local, "<u4"), n[local].astype("<i8"), np.array(langs, "<i4"),
                                  tail=head + b"\n".join(texts))) for b, (local, langs, texts) in sorted(found.items())]
            return pa.RecordBatch.from_pydict(_rows(part << BLOCK_BITS | block, pos, every[pos], sent), _RELATION)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found = tokens_of(text.as_py())
                own = numbers.get(lang)
                if own is None:
                    own = numbers[lang] = _Numbers(counter)
                held.append(np.fromiter(map(own.__getitem__, found), dtype=np.int32, count=len(found)))
                held.append(np.zeros(1, np.int32))
                size += len(found)
                if size >= BLOCK:
                    out = flush()
                    block, counter, numbers, held, size = block + 1, [0], {}, [], 0
                    yield out
        if size:
            out = flush()
            numbers, held = {}, []
            yield out

    return written(rows.mapInArrow(number, RELATION), "setm-1")


def _words_in(messages: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, list, list]:
    """Of each message the block's numbers and the bucket's; sums by the bucket's number; its languages and words."""
    seen: dict[tuple[str, bytes], int] = {}
    local, own, count = [], [], []
    for m in messages:
        at, n, of, tail = _opened(m, "<u4", "<i8", "<i4")
        k = int(np.frombuffer(tail, "<i8", 1)[0])
        place, names = 8 + 8 * k, []
        for size in np.frombuffer(tail, "<i8", k, 8).tolist():
            names.append(tail[place:place + size].decode())
            place += size
        keys = zip([names[i] for i in of.tolist()], tail[place:].split(b"\n"), strict=True)
        local.append(at)
        own.append(np.fromiter((seen.setdefault(x, len(seen)) for x in keys), dtype=np.int64, count=len(at)))
        count.append(n)
    sums = np.zeros(len(seen), dtype=np.int64)
    np.add.at(sums, np.concatenate(own), np.concatenate(count))
    return local, own, sums, [x for x, _ in seen], [w for _, w in seen]


def _pairs_in(messages: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The same for phrases of two parts: their ids in place of languages and words."""
    found = [_opened(m, "<u8", "<u8", "<i8") for m in messages]
    a = np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found]).astype(np.int64)
    b = np.concatenate([f[1] for f in found]).astype(np.int64)
    by = np.lexsort((b, a))
    head = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])
    own = np.empty(len(by), dtype=np.int64)
    own[by] = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    sums = np.add.reduceat(np.concatenate([f[2] for f in found])[by], first)
    cuts = np.cumsum([len(f[0]) for f in found])[:-1]
    local = [int.from_bytes(f[3], "little") + np.arange(len(f[0])) for f in found]
    return local, np.split(own, cuts), sums, a[by][first], b[by][first]


def frequent(relation: DataFrame, k: int, buckets: int, least: int) -> DataFrame:
    """What buckets answer, written once: block and message (numbers and ids of its frequent phrases); each frequent phrase
    (id, f and what it is made of); and of words the sum of all counts of a language in the bucket (lang, f)."""
    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        local, own, sums, x, y = (_words_in if k == 1 else _pairs_in)(table.column("message").to_pylist())
        often = np.flatnonzero(sums >= least)
        ids = np.zeros(len(sums), dtype=np.int64)
        ids[often] = np.arange(len(often)) * buckets + bucket + 1
        blocks, sent = [], []
        for block, at, mine in zip(table.column("block").to_pylist(), local, own, strict=True):
            got = ids[mine]
            keep = np.flatnonzero(got)
            if len(keep):
                by = keep[np.argsort(at[keep], kind="stable")]
                blocks.append(block)
                sent.append(_squeezed(np.diff(at[by].astype(np.int64), prepend=0).astype("<u4"), got[by].astype("<u8")))
        n = len(often)
        totals = Counter()
        if k == 1:
            for lang, c in zip(x, sums.tolist(), strict=True):
                totals[lang] += c
        pad = lambda values, kind: pa.concat_arrays([pa.nulls(len(blocks), kind), pa.array(values, kind)])
        made = ([pad([x[i] for i in often.tolist()], pa.string()), pad([y[i] for i in often.tolist()], pa.binary()).cast(pa.string()),
                 pa.nulls(len(blocks) + n, pa.int64()), pa.nulls(len(blocks) + n, pa.int64())] if k == 1 else
                [pa.nulls(len(blocks) + n, pa.string()), pa.nulls(len(blocks) + n, pa.string()), pad(x[often], pa.int64()),
                 pad(y[often], pa.int64())])
        out = pa.table([pa.array(blocks + [None] * n, pa.int64()), pa.array(sent + [None] * n, pa.binary()),
                        pad(ids[often], pa.int64()), pad(sums[often], pa.int64()), *made], _ANSWERS)
        return pa.concat_tables([out, pa.Table.from_pylist([{"lang": lang, "f": c} for lang, c in totals.items()], _ANSWERS)])

    sent = relation.filter(F.col("message").isNotNull()).select("block", "bucket", "message")
    return written(sent.groupBy("bucket").applyInArrow(
        settle, "block long, message binary, id long, f long, lang string, word string, a long, b long"), f"setm-frequent-{k}")


def longer(relation: DataFrame, found: DataFrame, k: int, buckets: int) -> DataFrame:
    """R(k + 1) by block, and the blocks' distinct phrases by bucket.  Written once."""
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _RELATION.empty_table()
        answers = [_opened(m, "<u4", "<u8")[:2] for m in right.column("message").to_pylist()]
        local = np.concatenate([np.cumsum(x, dtype=np.int64) for x, _ in answers])
        pos, gram = unpacked(left.column("occurrences")[0].as_py())
        pos, gram, a, b, n = next_relation(pos, gram, local, np.concatenate([i for _, i in answers]).astype(np.int64))
        if not len(pos):
            return _RELATION.empty_table()
        # a block's phrases are numbered in the order in which it sends them: a message names the first alone
        with np.errstate(over="ignore"):
            mix = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        bucket = ((mix >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        sent, first, renamed = [], 1, np.zeros(len(a) + 1, dtype=np.int64)
        for at, i in _by_bucket(bucket):
            renamed[i + 1] = np.arange(first, first + len(i))
            sent.append((at, _squeezed(np.diff(a[i], prepend=0).astype("<u8"), b[i].astype("<u8"), n[i].astype("<i8"),
                                       tail=first.to_bytes(8, "little"))))
            first += len(i)
        return pa.Table.from_pydict(_rows(left.column("block")[0].as_py(), pos, renamed[gram], sent), _RELATION)

    blocks = relation.filter(F.col("occurrences").isNotNull()).select("block", "occurrences").groupBy("block")
    answers = found.filter(F.col("block").isNotNull()).select(F.col("block").alias("to"), "message").groupBy("to")
    return written(blocks.cogroup(answers).applyInArrow(join, RELATION), f"setm-{k + 1}")


def _first(found: DataFrame) -> DataFrame:
    """Each frequent phrase once."""
    return found.filter(F.col("id").isNotNull()).drop("block", "message")


def _made_of(found: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """Words, counts of prefixes and suffixes, and keys (length, id) of the shorter phrases inside, from the two parts."""
    left = parts.select(F.col("id").alias("a"), F.col("lang").alias("of"), F.col("words").alias("head"), "pre", F.col("inside").alias("in_a"))
    right = parts.select(F.col("id").alias("b"), F.element_at("words", -1).alias("last"), "suf", F.col("inside").alias("in_b"))
    key = lambda c: F.struct(F.lit(k - 1).alias("k"), F.col(c).alias("id"))
    deep = F.array_distinct(F.concat("in_a", "in_b", F.array(key("a"), key("b")))) if k > 2 else _no_keys()
    return _first(found).select("id", "f", "a", "b").join(left, "a").join(right, "b").select(
        "id", F.col("of").alias("lang"), F.concat("head", F.array("last")).alias("words"), "f",
        F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"), deep.alias("inside"))


def _no_keys() -> Column:
    return F.expr("cast(array() as array<struct<k:int,id:bigint>>)")


def _cut(k: int) -> Column:
    """The lowest-scoring cut, of equal scores the one with the fewest words first."""
    def at(j: int) -> Column:
        left, right = F.element_at("pre", j), F.element_at("suf", k - j)
        score = F.expr(f"(cast(f as decimal(19,0)) * {SCALE}) div "
                       f"(cast(element_at(pre, {j}) as decimal(19,0)) + element_at(suf, {k - j}))")
        return F.struct(score.alias("score"), F.lit(j).alias("j"), left.alias("l"), right.alias("r"))
    return F.array_min(F.array(*[at(j) for j in range(1, k)]))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """lang, words, a, l, r, n, score of every phrase that stays, all ranks."""
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    buckets = shuffle_partitions(spark)
    relation = words(rows, buckets)
    found = frequent(relation, 1, buckets, least)
    totals = found.filter("id is null and block is null").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = _first(found).select("id", "lang", F.array("word").alias("words"), F.array("f").alias("pre"),
                                 F.array("f").alias("suf"), _no_keys().alias("inside"))
    every = []
    for k in range(2, longest + 1):
        relation = longer(relation, found, k - 1, buckets)
        found = frequent(relation, k, buckets, least)
        parts = written(_made_of(found, parts, k), f"setm-phrases-{k}")
        every.append(parts.select(F.lit(k).alias("k"), "id", "lang", "words", "f", "inside", _cut(k).alias("cut")))
    phrases = every[0]
    for more in every[1:]:
        phrases = phrases.unionByName(more)
    around = phrases.select(F.explode("inside").alias("x"), F.col("f").alias("_f")).groupBy("x.k", "x.id").agg(F.max("_f").alias("_most"))
    whole = F.expr(f"cast(_most as decimal(19,0)) * 100 >= cast(f as decimal(19,0)) * {int(inside)}")
    return (phrases.join(around, ["k", "id"], "left").filter(~F.coalesce(whole, F.lit(False))).join(totals, "lang")
            .select("lang", "words", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                    F.col("cut.score").alias("score")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(documents(spark, sf_dir).select("lang", "text")).withColumn("phrase", F.array_join("words", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM placed, (SELECT unnest(range(1, {LONGEST + 1})) AS k) AS ks
  WHERE i + k - 1 <= len(w)),
freq AS MATERIALIZED (
  SELECT lang, k, g, count(*) AS f, string_split(g, ' ') AS w FROM grams GROUP BY lang, k, g HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, k, g, f, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM freq, (SELECT unnest(range(1, {LONGEST})) AS j) AS js WHERE j < k),
scored AS (
  SELECT c.lang, c.g, c.f, c.j, a.f AS l, b.f AS r, ({SCALE}::HUGEINT * c.f) // (a.f + b.f) AS score
  FROM cuts c JOIN freq a ON a.lang = c.lang AND a.g = c.head JOIN freq b ON b.lang = c.lang AND b.g = c.tail),
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS g, max(f) AS most
  FROM freq, (SELECT unnest(range(2, {LONGEST})) AS m) AS ms, (SELECT unnest(range(1, {LONGEST})) AS s) AS ss
  WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT c.* FROM cut c LEFT JOIN inside i ON i.lang = c.lang AND i.g = c.g
  WHERE i.most IS NULL OR 100 * i.most::HUGEINT < {INSIDE} * c.f::HUGEINT),
ranked AS (
  SELECT kept.lang, g AS phrase, f AS a, l, r, n, score::BIGINT AS score,
         row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, f DESC, g) AS rank
  FROM kept JOIN totals ON totals.lang = kept.lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
