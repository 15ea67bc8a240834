"""Vector kernels as column builders: everything stays in the JVM as higher-order functions over ``array<double>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(v: Column | str | Sequence[float]) -> Column:
    """A column, or literal numbers, as ``array<double>``."""
    if isinstance(v, (Column, str)):
        c = F.col(v) if isinstance(v, str) else v
        return c.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(as_vector(a), as_vector(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(as_vector(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if either vector is zero; kept within [-1, 1]."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def l2(a, b) -> Column:
    return F.sqrt(total(F.zip_with(as_vector(a), as_vector(b), lambda x, y: (x - y) * (x - y))))


def l1(a, b) -> Column:
    return total(F.zip_with(as_vector(a), as_vector(b), lambda x, y: F.abs(x - y)))


def euclidean_similarity(a, b) -> Column:
    """exp(-d / dimension)."""
    return F.exp(-l2(a, b) / F.size(as_vector(a)))


def manhattan_similarity(a, b) -> Column:
    """exp(-d / (2 * dimension))."""
    return F.exp(-l1(a, b) / (2 * F.size(as_vector(a))))


def root_euclidean_similarity(a, b) -> Column:
    """exp(-d / sqrt(dimension)) within [0, 1]: the kernel of the outcome predictor."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-l2(a, b) / F.sqrt(F.size(as_vector(a)).cast("double")))))


def section_weights(n: int) -> list[float]:
    """1, and 1.2 on the middle half of the dimensions, scaled so that they add up to ``n``."""
    w = [1.2 if n // 4 <= i < 3 * n // 4 else 1.0 for i in range(n)]
    return [x * n / sum(w) for x in w]


def weighted_cosine(a, b, weights: Sequence[float]) -> Column:
    w = as_vector(weights)
    scale = lambda v: F.zip_with(as_vector(v), w, lambda x, y: x * y)
    return cosine(scale(a), scale(b))


def normalized(a) -> Column:
    """Scaled to length one; a zero vector stays."""
    v, n = as_vector(a), norm(a)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def well_formed(a, dimension: int) -> Column:
    """Not null, of the dimension and finite in every place."""
    v = as_vector(a)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


METHODS = {
    "cosine": cosine,
    "euclidean": euclidean_similarity,
    "manhattan": manhattan_similarity,
    "dot": dot,
    "jaccard": cosine,
    "semantic_similarity": cosine,
}


def similarity(a, b, method: str = "cosine") -> Column:
    """The kernel of that name; the two names without a kernel of their own mean cosine."""
    if method not in METHODS:
        raise ValueError(f"unknown similarity method {method!r}")
    return METHODS[method](a, b)


def distance(a, b, metric: str) -> Column:
    """cosine, l2, or inner_product (negated, so that smaller is nearer)."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "l2":
        return l2(a, b)
    if metric == "inner_product":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def score(d: Column, metric: str) -> Column:
    """Distance to score: 1 - d, 1 / (1 + d), or the inner product itself."""
    return {"cosine": 1 - d, "l2": 1 / (1 + d), "inner_product": -d}[metric]
