"""Mixture-controlled packing: deficit round-robin over source queues fills fixed token windows.

Every source is a queue of tokens, its documents in storage order, each ended by an end id.  In every
round each queue's credit grows by its target share of a window; it sends whole grains from its
credit and carries the deficit on.  The rounds, joined, are one stream, cut every WINDOW tokens
into sequences: all are full but the last, and a document may be cut anywhere.  When a queue runs
dry, its share goes to the others.

What a queue has sent by the start of a round is a closed form of the round and the queues' totals.
So any task places its own documents: it needs the totals (at most QUEUES numbers), and its rows' offsets in
their queues.  Those come from per-task counts in the table of token ids, written once to the shared
folder; deficits thus carry across windows, rounds and partitions without a sequential pass.

Edge cases: a null or empty text is the end id alone; a null source has its own queue; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready, written

WINDOW = 2048
GRAIN = 64          # tokens a queue sends at least, unless it runs dry
END_ID = 1
QUEUES = 1024       # the largest sources have a queue of their own, the others share one
TEMPERATURE = 0.7   # default targets: a source's share of tokens to this power
CACHE_WORDS = 600_000
CHUNK_TOKENS = 500_000     # tokens cut at once (one longer document is a chunk)
CHUNK_ROWS = 2048          # texts encoded before their ids leave the worker,
CHUNK_BYTES = 16 << 20     # or fewer of so many bytes (one longer text is a chunk)
REST = "\x00rest"   # label of the shared queue
NULL = "\x00null"   # label of the null source's queue


class WordEncoder:
    """Token ids of texts by one encoding per distinct blank-separated piece.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    pieces in order.  A piece of Latin letters and then signs is the ids of its letters, in lower case, and
    of its signs: the tokenizer splits there and lower-cases.  Such parts are one pre-token each and end
    in a token marked as a word end, so many are encoded in one call and told apart by these marks.
    Other pieces are encoded one by one.  Texts are split, looked up and joined as Arrow columns: Python
    meets only parts and pieces that are new.  What is known is bounded: it starts anew when full.
    """

    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    LETTERS = "".join(chr(c) for c in range(0x100) if chr(c).isalpha() and chr(c) not in "ªµº")
    WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    PART = r"^(?:[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)$"

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids are kept in 2 bytes: the tokenizer has more than 65,536")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _each(self, pieces: list[str]) -> pa.Array:
        found = self.encode(pieces, add_special_tokens=False)
        return pa.array([np.array(e.ids, dtype="<u2").tobytes() for e in found], pa.binary())

    def _learn(self, new: pa.Array) -> None:
        part = pc.match_substring_regex(new, self.PART)
        # in order: neighbours share their beginnings, which the tokenizer then has at hand
        parts, others = sorted(new.filter(part).to_pylist()), sorted(new.filter(pc.invert(part)).to_pylist())
        found = [self.known_ids, self._each(others)]
        if parts:
            ids = np.concatenate([np.array(e.ids, dtype="<u2") for e in self.encode(
                [" ".join(parts[i:i + 500]) for i in range(0, len(parts), 500)], add_special_tokens=False)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(parts):
                to = np.concatenate([[0], 2 * (last + 1)]).astype(np.int32)
                found.append(pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(to), pa.py_buffer(ids)]))
            else:                                          # a tokenizer without such marks
                found.append(self._each(parts))
        self.known = pa.concat_arrays([self.known, pa.array(others + parts, pa.string())])
        self.known_ids = pa.concat_arrays(found)

    def _look_up(self, keys: pa.Array) -> pa.Array:
        """The ids of distinct parts and pieces."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.known_ids = self.known[:0], self.known_ids[:0]
        at = pc.index_in(keys, value_set=self.known)
        if at.null_count:
            new, before = pc.is_null(at), len(self.known)
            self._learn(keys.filter(new))
            place = pc.index_in(keys.filter(new), value_set=self.known[before:])
            at = pc.replace_with_mask(at, new, pc.add(place, pa.scalar(before, pa.int32())))
        return self.known_ids.take(at)

    def ids(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text (little-endian, 2 bytes an id), with ``end`` after them."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = pc.dictionary_encode(split.flatten())
        pieces = found.dictionary
        word = pc.utf8_rtrim(pieces, self.SIGNS)
        plain = pc.match_substring_regex(word, self.WORD)
        keys = pc.dictionary_encode(pa.concat_arrays([
            pc.if_else(plain, pc.utf8_lower(word), pieces),
            pc.if_else(plain, pc.utf8_ltrim(pieces, self.LETTERS), "")]))
        of = self._look_up(keys.dictionary)
        own, signs = (of.take(keys.indices[i:i + len(pieces)]) for i in (0, len(pieces)))
        of = pa.concat_arrays([pc.binary_join_element_wise(own, signs, b""), pa.array([end], pa.binary())])
        # the end follows each text's last piece; joined, the ids of the pieces are those of the texts
        n = split.value_lengths().to_numpy()
        rows = of.take(pa.array(np.insert(found.indices.to_numpy(), np.cumsum(n), len(pieces))))
        bounds = np.frombuffer(rows.buffers()[1], np.int32)[np.concatenate([[0], np.cumsum(n + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), rows.buffers()[2]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker: what it has learned serves the next task too."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], enc: WordEncoder, end_id: int) -> Iterator[pa.RecordBatch]:
    """The rows of doc_id, source, part, text with their ids, at most CHUNK_ROWS and some CHUNK_BYTES at a time however
    long a batch is."""
    end = np.array([end_id], dtype="<u2").tobytes()
    sent: dict[str, int] = {}
    for whole in batches:
        texts = pc.fill_null(whole.column("text").cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = 0
        while at < whole.num_rows:
            most = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")) - at
            batch = whole.slice(at, min(CHUNK_ROWS, max(1, most)))
            at += batch.num_rows
            ids = enc.ids(texts.slice(at - batch.num_rows, batch.num_rows), end)
            n, start = (pc.binary_length(ids).to_numpy() // 2).tolist(), []
            for source, tokens in zip(batch.column("source").to_pylist(), n, strict=True):
                start.append(sent.get(source, 0))
                sent[source] = start[-1] + tokens
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("part"), pa.array(n, pa.int64()),
                 pa.array(start, pa.int64()), ids],
                names=["doc_id", "source", "part", "n", "start", "ids"])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id",
              text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n, ids (little-endian, 2 bytes an id), part and start: the written part, and the
    tokens of the same source before this row in that part."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, encoder(tokenizer), end_id)

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                     F.spark_partition_id().alias("part"), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(encode, f"doc_id {kind}, source string, part int, n long, start long, ids binary")


class Rounds:
    """The deficit round-robin schedule over queues with ``totals`` tokens and target ``weights``."""

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW, grain: int = GRAIN):
        self.total = np.array(totals, dtype=np.int64)
        self.weight = np.array(weights, dtype=float)
        self.grain = grain
        # credit grows with a common clock; a queue runs dry at total / weight
        self.dry = self.total / self.weight
        ends = np.unique(self.dry)
        starts = np.concatenate([[0.0], ends[:-1]])
        active = np.array([self.weight[self.dry > s].sum() for s in starts])
        rounds = np.maximum(1, np.ceil((ends - starts) * active / window)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(rounds)])       # first round of each phase
        self.clock, self.step = starts, window / active
        self.ends = ends

    def at(self, r: np.ndarray) -> np.ndarray:
        """The clock when round r starts."""
        r = np.minimum(r, self.first[-1])
        p = np.clip(np.searchsorted(self.first, r, side="right") - 1, 0, len(self.ends) - 1)
        return np.where(r >= self.first[-1], self.ends[-1],
                        np.minimum(self.clock[p] + (r - self.first[p]) * self.step[p], self.ends[p]))

    def sent(self, q: np.ndarray | int, v: np.ndarray) -> np.ndarray:
        """Tokens that queue q has sent at clock v."""
        credit = (np.floor(self.weight[q] * v / self.grain) * self.grain).astype(np.int64)
        return np.where(v >= self.dry[q], self.total[q], np.minimum(credit, self.total[q]))

    def round_of(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The rounds that send tokens x of queues q."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), int(self.first[-1]), np.int64)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            low = self.sent(q, self.at(mid)) <= x
            lo, hi = np.where(low, mid, lo), np.where(low, hi, np.maximum(mid, lo + 1))
        return lo

    def pieces(self, q: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Pieces of the documents i with tokens [a, b) of queue q, in order: i, first and end token, place in the stream."""
        r0, r1 = self.round_of(q, a), self.round_of(q, b - 1)
        n = r1 - r0 + 1
        doc = np.repeat(np.arange(len(a)), n)
        r = np.repeat(r0 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        v, w, mine = self.at(r), self.at(r + 1), q[doc]
        now, after = self.sent(mine, v), self.sent(mine, w)
        place = np.zeros(len(r), np.int64)                  # where this queue's turn in the round begins
        for s in range(len(self.total)):
            own = self.sent(s, v)
            place += np.where(s < mine, self.sent(s, w), own)
        lo, hi = np.maximum(now, a[doc]), np.minimum(after, b[doc])
        place = place + lo - now
        keep = hi > lo
        doc, lo, hi, place = doc[keep], lo[keep], hi[keep], place[keep]
        # cut at window ends
        cuts = (place % window + (hi - lo) - 1) // window + 1
        j = np.arange(cuts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(cuts)[:-1]]), cuts)
        doc, lo, hi, place = (np.repeat(x, cuts) for x in (doc, lo, hi, place))
        begin = np.where(j > 0, (place // window + j) * window, place)
        end = np.minimum((place // window + j + 1) * window, place + hi - lo)
        lo, hi, place = lo + begin - place, lo + end - place, begin
        # and join what touches inside a window
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + hi[:-1] - lo[:-1]) | (place[1:] % window == 0)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
        return doc[first], lo[first], hi[last], place[first]


def queue_totals(tokens: DataFrame, queues: int = QUEUES) -> list[tuple[str, int]]:
    """(queue, tokens), by name: the largest sources, then the shared queue.  At most ``queues`` rows."""
    label = F.coalesce(F.col("source"), F.lit(NULL))
    per = tokens.groupBy(label.alias("q")).agg(F.sum("n").alias("t"))
    top = [(r["q"], r["t"]) for r in per.orderBy(F.desc("t"), "q").limit(queues - 1).collect()]
    rest = (tokens.agg(F.sum("n")).first()[0] or 0) - sum(t for _, t in top)
    return sorted(top) + ([(REST, rest)] if rest else [])


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, window: int = WINDOW,
         grain: int = GRAIN, temperature: float = TEMPERATURE, **columns: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian, 4 bytes an id), doc_tokens, sequence_id,
    offset, queue."""
    spark = docs.sparkSession
    ready(spark)
    tokens = written(tokenized(docs, tokenizer, **columns), "pack-tokens")
    found = queue_totals(tokens.select("source", "n"))
    names = [q for q, _ in found]
    weights = [max(1e-9, float(targets.get(q, 0))) if targets else t ** temperature for q, t in found]
    whole = sum(weights)
    rounds = Rounds([t for _, t in found], [w / whole for w in weights], window, grain) if found else None
    # tokens of a source (or of the shared queue) before each written part
    own = F.col("source").isin([q for q in names if q not in (REST, NULL)])
    queue = (F.when(F.col("source").isNull(), F.lit(NULL)) if NULL in names else F.when(F.lit(False), F.lit(""))) \
        .when(own, F.col("source")).otherwise(F.lit(REST))
    tokens = tokens.withColumn("queue", queue)
    per = tokens.groupBy("queue", "part", "source").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(Window.partitionBy("queue").orderBy("part", "source")) - F.col("t")
    per = per.select("part", F.col("source").alias("_source"), before.alias("before"))
    tokens = tokens.join(per.withColumnRenamed("part", "_part"),
                         (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    tokens = tokens.select("doc_id", "queue", (F.col("before") + F.col("start")).alias("first"), "n", "ids")
    index = {q: i for i, q in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()                                   # the ids are written: a worker used again needs no caches
        for whole in batches:
            n_all = np.asarray(whole.column("n"))
            at = 0
            while at < len(n_all):                          # some rows at a time, by their tokens
                size = max(1, int(np.searchsorted(np.cumsum(n_all[at:]), CHUNK_TOKENS)))
                batch = whole.slice(at, size)
                at += size
                n, first = np.asarray(batch.column("n")), np.asarray(batch.column("first"))
                names = batch.column("queue").to_pylist()
                q = np.array([index[x] for x in names], dtype=np.int64)
                doc, lo, hi, place = rounds.pieces(q, first, first + n, window)
                # pieces follow each other through the documents' ids: only the bounds are new
                ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2").astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32) * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(lo - first[doc]), pa.array(hi - lo),
                     pa.array(n[doc]), pa.array(place // window), pa.array(place % window),
                     pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]),
                     batch.column("queue").take(pa.array(doc))],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "queue"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, "
                                  "offset long, ids binary, queue string")


def pieces_of(docs: DataFrame, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    import public_tokenizers
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), **options)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "queue")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(documents(spark, sf_dir))
