"""Vector expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE = "cosine"
L2 = "l2"
METRICS = (COSINE, L2)


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def as_double(v: Column) -> Column:
    """Widen to double first: arithmetic on two float arrays stays float."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; the root is never taken."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column, norm: Column | None = None) -> Column:
    """Scale to unit length; a zero vector stays as it is.

    The norm is handed over as an array: inside the lambda it would be computed
    again for every component.
    """
    norm = l2_norm(v) if norm is None else norm
    divisor = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.zip_with(v, F.array_repeat(divisor, F.size(v)), lambda x, n: x / n)


def l2_score(distance: Column) -> Column:
    """1 / (1 + squared distance), in (0, 1]."""
    return 1.0 / (1.0 + distance)


def cosine_score(similarity: Column) -> Column:
    """Map [-1, 1] to [0, 1]."""
    return (similarity + 1.0) / 2.0


def score(raw: Column, metric: str) -> Column:
    return cosine_score(raw) if metric == COSINE else l2_score(raw)


def require_vector(v: Column, record_id: Column, dim: int | None = None) -> Column:
    """The vector itself, or a runtime error naming the record without one.

    The check is part of the value, so column pruning cannot remove it. With
    ``dim`` a vector of another length is an error too.
    """
    missing = F.raise_error(
        F.concat(F.lit("no vector given for id "), record_id.cast("string"))
    )
    checked = F.coalesce(v, missing)
    if dim is None:
        return checked
    wrong = F.raise_error(
        F.concat(
            F.lit("vector of id "),
            record_id.cast("string"),
            F.lit(f" does not have {dim} dimensions"),
        )
    )
    return F.when(F.size(v) == dim, v).when(v.isNull(), missing).otherwise(wrong)
