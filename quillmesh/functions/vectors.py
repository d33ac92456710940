"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_literal(vector: Column, query: list[float]) -> Column:
    """Dot product with a fixed vector, the literal's elements unrolled so that codegen sees plain arithmetic."""
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in query]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v)


def unit_norm(v: Column, tolerance: float = 1e-3) -> Column:
    """Whether a vector has unit length; all zeros pass, NaN doesn't."""
    n = norm(v)
    return ~F.isnan(n) & ((n == 0) | (F.abs(n - 1) <= tolerance))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1 (arrays of arrays); zeros if none is."""
    kept = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] == 1)
    width = F.size(hidden[0])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, t: F.zip_with(s, t["h"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: F.when(F.size(kept) > 0, x / F.size(kept)).otherwise(F.lit(0.0)))
