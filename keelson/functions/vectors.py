"""Vector columns (``array<double>``) and rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: str | Column, least: float = 1e-12) -> Column:
    """FUN-01: rows over max(norm, 1e-12)."""
    v = F.col(v) if isinstance(v, str) else v
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(least))), lambda n: F.transform(v, lambda x: x / n)), 1)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def reasons(*checks: tuple[Column, str]) -> Column:
    """The codes of all checks that fail (are true), in order; a null check counts as failing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in checks]))
