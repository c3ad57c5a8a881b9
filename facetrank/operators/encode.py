"""Text encoding (V1) and masked mean pooling (V2).

``encode_pooled`` is the form that the retrieval flow uses: a text is cut into at most MAX_TOKENS tokens, a
token encoder (a callable ``tokens -> (n x dims array, mask of n)``, built once per Python worker) gives each a vector
and a mask, and the vectors are averaged under the mask and normalised, Arrow batch by Arrow batch.  The shipped token
encoder gives a token the unit vector of its md5 bucket and masks tokens of ASCII punctuation alone.

``encode_texts`` runs a pluggable encoder in an iterator ``mapInPandas``: the
encoder is built once per Python worker and fed Arrow batches of whole texts.
A neural encoder is a callable ``texts -> ndarray (n, dims)``.  The shipped
default is model-free and deterministic: a hashed bag of whitespace tokens
(bucket = first 8 hex digits of the token's md5, modulo ``dims``), L2
normalised, so the SQL oracle can recompute it.

``mean_pool`` is a pure DataFrame aggregate: per group and position,
``sum(mask * x) / max(sum(mask), 1e-9)``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
TokenEncoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
_WS = re.compile(r"[ \t\n\r\f\v]+")
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")
MASK_FLOOR = 1e-9
NORM_FLOOR = 1e-12
MAX_TOKENS = 512
DIMS = 64


class HashedTokenEncoder:
    def __init__(self, dims: int = 64):
        self.dims = dims
        self._cache: dict[str, int] = {}

    def bucket(self, tok: str) -> int:
        b = self._cache.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dims
            if len(self._cache) < 1_000_000:
                self._cache[tok] = b
        return b

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        for i, t in enumerate(texts):
            for tok in _WS.split(t or ""):
                if tok:
                    out[i, self.bucket(tok)] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norms, 1e-12)


def encode_texts(df: DataFrame, text_col: str = "text", key: str = "doc_id",
                 encoder_factory: Callable[[], Encoder] = HashedTokenEncoder) -> DataFrame:
    """key, vector array<double>: one vector per row, as many vectors as rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder_factory()
        for pdf in batches:
            vecs = enc(pdf[text_col].fillna("").tolist())
            if len(vecs) != len(pdf):
                raise ValueError("encoder returned a different number of vectors than texts")
            yield pd.DataFrame({key: pdf[key].to_numpy(), "vector": list(vecs)})
    key_type = dict(df.dtypes)[key]
    return df.select(key, text_col).mapInPandas(run, f"{key} {key_type}, vector array<double>")


class HashedTokens(HashedTokenEncoder):
    """Token vectors: the unit vector of the token's bucket; punctuation is masked."""

    def __init__(self, dims: int = DIMS):
        super().__init__(dims)

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        vectors = np.zeros((len(tokens), self.dims))
        vectors[np.arange(len(tokens)), [self.bucket(t) for t in tokens]] = 1.0
        return vectors, np.array([0.0 if _MARKS.fullmatch(t) else 1.0 for t in tokens])


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the vectors under the mask, normalised; zero if nothing is left."""
    mean = (vectors * mask[:, None]).sum(0) / max(mask.sum(), MASK_FLOOR)
    return mean / max(float(np.linalg.norm(mean)), NORM_FLOOR)


def encode_pooled(df: DataFrame, text_col: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (),
                  encoder_factory: Callable[[], TokenEncoder] = HashedTokens, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """key, the kept columns, vector array<double>: one vector a row, whatever its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_factory()
        for b in batches:
            out = []
            for text in b.column("_text").to_pylist():
                # the first tokens alone are cut off a text; one more split keeps the rest in one piece
                tokens = [t for t in _WS.split((text or "").lstrip(" \t\n\r\f\v"), maxsplit=max_tokens)[:max_tokens] if t]
                vectors, mask = enc(tokens)
                if len(vectors) != len(tokens) or len(mask) != len(tokens):
                    raise ValueError("encoder returned a different number of vectors than tokens")
                out.append(pooled(vectors, mask).tolist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, *keep)], pa.array(out, pa.list_(pa.float64()))],
                                             names=[key, *keep, "vector"])

    kinds = dict(df.dtypes)
    rows = df.select(key, *keep, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (key, *keep)) + ", vector array<double>")


def mean_pool(tokens: DataFrame, group: str, vector: str = "vector", mask: str | None = None) -> DataFrame:
    """group, pos, value: masked mean of the token vectors per position (long form)."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    x = tokens.select(group, m.alias("_m"), F.posexplode(vector).alias("pos", "x"))
    agg = x.groupBy(group, "pos").agg(F.sum(F.col("x").cast("double") * F.col("_m")).alias("s"),
                                      F.sum("_m").alias("n"))
    return agg.select(group, F.col("pos").cast("long").alias("pos"),
                      (F.col("s") / F.greatest(F.col("n"), F.lit(MASK_FLOOR))).alias("value"))
