"""Vector expressions over arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """``v`` by its norm, which counts as 1e-12 at least."""
    norm = F.greatest(l2_norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: (x / norm).cast("float"))


def all_finite(v: Column) -> Column:
    """True if no component is null, NaN or infinite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def int8_scale(v: Column) -> Column:
    """Largest absolute component by 127 in single precision, 1e-12 at least."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("float"))))
    return F.greatest((top / F.lit(127).cast("float")).cast("float"), F.lit(1e-12).cast("float"))


def int8_codes(v: Column, scale: Column) -> Column:
    """Components by ``scale``, rounded half away from zero, within -127 and 127."""

    def code(x: Column) -> Column:
        q = F.round((x.cast("float") / scale).cast("float")).cast("int")
        return F.greatest(F.lit(-127), F.least(F.lit(127), q)).cast("byte")

    return F.transform(v, code)


def int8_decode(codes: Column, scale: Column, normalized: bool) -> Column:
    """Codes by scale in single precision, brought to unit length if ``normalized``."""
    plain = F.transform(codes, lambda c: (c.cast("float") * scale).cast("float"))
    return normalize(plain) if normalized else plain


def total_order(score: Column) -> list[Column]:
    """Sort keys for descending scores under which 0.0 stands above -0.0."""
    negative_zero = (score == 0) & score.cast("string").startswith("-")
    return [score.desc(), F.when(negative_zero, 1).otherwise(0).asc()]
