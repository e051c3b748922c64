"""Vector helpers: cosine distance as a JVM expression and as numpy blocks.

Spark 4.1 has no vector built-in.  Pairwise distances between two columns
use ``aggregate(zip_with(...))`` (JVM, double precision).  Many-against-many
search uses unit-normalised float64 blocks inside ``mapInPandas`` so that no
(query, row) pair is ever materialised as a Spark row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(
        F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine_distance(a, b) -> Column:
    """``1 - cos(a, b)``; null when either side is null, empty or all zero."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0) & (F.size(_c(a)) == F.size(_c(b))),
                  F.lit(1.0) - dot(a, b) / (na * nb))


def cosine_distance_to(a, q: list[float]) -> Column:
    """Distance from column ``a`` to one literal vector (norm folded on the driver)."""
    qv = np.asarray(q, dtype=np.float64)
    qn = float(np.linalg.norm(qv))
    if qn == 0.0:
        return F.lit(None).cast("double")
    lit = F.array(*[F.lit(float(x)) for x in qv])
    na = norm(a)
    return F.when(na > 0, F.lit(1.0) - dot(a, lit) / (na * F.lit(qn)))


def unit_rows(vectors, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stack vectors into a float64 matrix of unit rows; returns (matrix, valid mask).

    Rows of another length than ``dim`` are marked invalid, the others stay;
    without ``dim`` the most frequent length of the rows counts."""
    if len(vectors) == 0:
        return np.zeros((0, 0)), np.zeros(0, dtype=bool)
    if dim is None:
        sizes = Counter(len(v) for v in vectors if v is not None and len(v))
        dim = max(sizes, key=lambda n: (sizes[n], -n), default=0)
    m = np.zeros((len(vectors), dim), dtype=np.float64)
    ok = np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim and dim > 0:
            m[i] = np.asarray(v, dtype=np.float64)
            ok[i] = True
    n = np.linalg.norm(m, axis=1)
    ok &= n > 0
    m[ok] /= n[ok, None]
    return m, ok
