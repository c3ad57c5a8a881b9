"""Language identification by error-correcting output codes.

Every language gets a codeword of bits, far from every other.  A text is the vector of its hashed byte
n-grams (1 to 3 bytes, letters lower-cased); one linear classifier per bit is trained by logistic
regression on a bounded sample.  Decoding is loss-weighted: a bit counts by the share of a
language's own training texts on which its classifier was right; the codeword of least total loss
wins, and a small gap to the next one flags the text as ambiguous.

Training uses every label, with at most PER_LANGUAGE texts each and SAMPLE in all (an even share a label, an error
if there are more labels than that): those with the smallest hash of their id; the thresholds of that hash come
from an id-only pass.  Prediction reads
whole texts, and of a row nothing but the text.

Edge cases: null texts and texts without a letter are ``und`` with score 0; null labels are not
learned from; without any training text every prediction is ``und``; with one language it is
predicted for every text with letters; repeated rows get equal results; an empty table gives no rows;
other columns pass through, and those named like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready

DIM = 4096
PER_LANGUAGE = 600    # training texts of a language at most
SAMPLE = 38_400       # training texts of all languages together at most
AMBIGUOUS = 0.05      # least gap, in score, between the best codeword and the next
UNKNOWN = "und"
RESULT = ("lang_pred", "score", "second", "ambiguous")


def features(text: str) -> np.ndarray:
    """Hashed counts of the bytes' 1-, 2- and 3-grams, square-rooted, of length one."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    letters = (b >= 97) & (b <= 122) | (b >= 128)
    b = np.where(letters, b, 32).astype(np.uint32)      # digits, signs and blanks all end a word
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    grams = [b, b[:-1] << 8 | b[1:] | 1 << 24]
    if len(b) > 2:
        grams.append(b[:-2] << 16 | b[1:-1] << 8 | b[2:] | 2 << 24)
    h = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - 12)
    v = np.sqrt(np.bincount(h, minlength=DIM).astype(np.float32))
    return v / max(1e-9, float(np.sqrt((v * v).sum())))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """One row of +-1 bits per language: all splits for up to 6 languages, else random rows kept far apart."""
    if n == 0:
        return np.zeros((0, 0), np.float32)
    if n <= 6:
        cols = [[1 if (m >> i) & 1 or i == 0 else -1 for i in range(n)] for m in range(0, 2 ** n, 2)]
        cols = [c for c in cols if min(c) < 0]          # the last split is empty
        return np.array(cols, dtype=np.float32).T.reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(int(min(200, max(1, 4e9 // (n * n * bits))))):    # fewer draws where each is dear
        code = rng.choice([-1.0, 1.0], size=(n, bits)).astype(np.float32)
        gap = min(((bits - code[i:i + 1000] @ code.T) / 2 + np.eye(len(code[i:i + 1000]), n, i) * bits).min()
                  for i in range(0, n, 1000))
        if gap > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, gap
    return best


class Model:
    """languages, code (L x bits), weights (DIM+1 x bits) and trust (L x bits)."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 20.0,
                 decay: float = 1e-5):
        self.languages = languages
        self.code = codewords(len(languages))
        bits = self.code.shape[1]
        self.weights = np.zeros((x.shape[1], bits), np.float32)
        if not bits:
            self.trust = np.ones((len(languages), 0), np.float32)
            return
        target = self.code[y]
        share = np.bincount(y, minlength=len(languages)).astype(np.float32)
        each = (1.0 / share[y] / len(languages))[:, None].astype(np.float32)   # languages count alike
        moment = np.zeros_like(self.weights)
        for _ in range(steps):
            m = np.clip(target * (x @ self.weights), -30, 30)
            grad = -(x.T @ (target * each / (1 + np.exp(m)))) + decay * self.weights
            moment = 0.9 * moment - rate * grad
            self.weights += moment
        right = ((x @ self.weights) * target > 0).astype(np.float32)
        trust = np.stack([right[y == c].mean(0) for c in range(len(languages))])
        self.trust = trust / np.maximum(1e-9, trust.sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list, np.ndarray, list, np.ndarray]:
        """language, score, second language, gap of each text."""
        n, langs = len(texts), self.languages
        ok = [t is not None and has_letter(t) for t in texts]
        names, seconds = [UNKNOWN] * n, [None] * n
        score, gap = np.zeros(n), np.zeros(n)
        at = [i for i in range(n) if ok[i]] if langs else []
        for k in range(0, len(at), 256):
            part = at[k:k + 256]
            x = np.stack([features(texts[i]) for i in part])
            f = x @ self.weights[:-1] + self.weights[-1]
            loss = np.stack([(np.logaddexp(0, -self.code[c] * f) * self.trust[c]).sum(1)
                             for c in range(len(langs))], axis=1)
            z = -4.0 * loss
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")
            for j, i in enumerate(part):
                names[i], score[i] = langs[order[j, 0]], p[j, order[j, 0]]
                gap[i] = score[i] - (p[j, order[j, 1]] if len(langs) > 1 else 0)
                seconds[i] = langs[order[j, 1]] if len(langs) > 1 else None
        return names, score, seconds, gap


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Train on a bounded sample of every label: at most ``sample`` texts reach the driver, as vectors."""
    h = F.xxhash64(F.col(id_col))
    ids = docs.filter(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), h.alias("h"))
    labels = ids.select("label").distinct().count()
    if not labels:
        return Model([], np.ones((0, DIM + 1), np.float32), np.zeros(0, int))
    each = min(per_language, sample // labels)
    if not each:
        raise ValueError(f"{labels} labels, but the sample holds {sample} texts: less than one a label")
    # the smallest hashes of each label: planned with a limit per group in every task, before the shuffle
    first = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    least = ids.withColumn("r", first).filter(F.col("r") <= each) \
        .groupBy(F.col("label").alias("_label")).agg(F.max("h").alias("_least"))   # at most ``sample`` rows

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(x, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in keep], pa.string()),
                 pa.array([features(t).astype("<f2").tobytes() for _, t in keep], pa.binary())], names=["label", "v"])

    chosen = docs.filter(train & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), h.alias("h")) \
        .join(F.broadcast(least), (F.col("label") == F.col("_label")) & (F.col("h") <= F.col("_least"))) \
        .select("label", "text").mapInArrow(vectors, "label string, v binary")
    # rows that repeat an id share its hash: their label is cut to its share, not the labels to the sample
    rows = chosen.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("v"))).filter(F.col("r") <= each) \
        .orderBy("label", "v").select("label", "v")
    # Arrow batches: the driver's JVM hands their bytes on, and no row becomes an object on either side
    return Model(*training(rows.toArrow()))


def training(rows: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """languages, vectors with a last column of ones, and labels of the rows of label, v."""
    names = sorted(rows.column("label").unique().to_pylist())
    x = np.ones((rows.num_rows, DIM + 1), np.float32)
    y = np.zeros(rows.num_rows, dtype=int)
    at = 0
    for batch in rows.to_batches():
        if batch.num_rows:
            some = slice(at, at := at + batch.num_rows)
            v = batch.column("v")
            x[some, :DIM] = np.frombuffer(v.buffers()[2], "<f2", batch.num_rows * DIM, _first_byte(v)).reshape(-1, DIM)
            y[some] = [names.index(label) for label in batch.column("label").to_pylist()]
    return names, x, y


def _first_byte(cells: pa.Array) -> int:
    """Where the first of the binary cells begins in their buffer."""
    wide = np.int64 if pa.types.is_large_binary(cells.type) else np.int32
    return int(np.frombuffer(cells.buffers()[1], wide, 1, cells.offset * np.dtype(wide).itemsize)[0])


def identify(docs: DataFrame, model: Model, text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score, second and ambiguous.

    The model (bounded: DIM + 1 weights a bit) is sent with the function.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in RESULT]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, score, second, gap = m.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(second, pa.string()),
                 pa.array([n != UNKNOWN and g < ambiguous for n, g in zip(names, gap, strict=True)])],
                names=[*kept, *RESULT])

    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(run, schema + ", lang_pred string, score double, second string, ambiguous boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "second", "ambiguous")
