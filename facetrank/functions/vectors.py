"""Vector column expressions (JVM-side higher-order functions, double arithmetic).

Spark 4.1 has no built-in vector cosine for array columns, so the products are
written with ``zip_with`` and ``aggregate``; they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def l2_normalize(a: Column | str) -> Column:
    n = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return F.transform(_c(a), lambda x: x.cast("double") / n)
