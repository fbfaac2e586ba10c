"""Rigid transforms as columns: ``array<double>`` of 16, row-major, metres. All expressions, no Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at(t: str | Column, row: int, column: int) -> Column:
    return F.get(col(t), F.lit(4 * row + column))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def yaw_transform(yaw_deg: str | Column, x: str | Column, y: str | Column, z: str | Column = None) -> Column:
    """Rotation about z by degrees, then a shift."""
    c, s = F.cos(F.radians(col(yaw_deg))), F.sin(F.radians(col(yaw_deg)))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, col(x).cast("double"), s, c, zero, col(y).cast("double"), zero, zero, one, zero if z is None else col(z).cast("double"), zero, zero, zero, one)


def compose(a: str | Column, b: str | Column) -> Column:
    """SE3-02: the product ``a b``."""
    return F.array(*[total([at(a, i, k) * at(b, k, j) for k in range(4)]) for i in range(4) for j in range(4)])


def inverse(t: str | Column) -> Column:
    """SE3-03: the closed form for rigid transforms, ``[R', -R' t]``."""
    rows = [[at(t, k, i) for k in range(3)] + [-total([at(t, k, i) * at(t, k, 3) for k in range(3)])] for i in range(3)]
    return F.array(*[x for r in rows for x in r], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def transpose(t: str | Column) -> Column:
    """CMP-20's load rule: column-major lists become row-major."""
    return F.array(*[at(t, j, i) for i in range(4) for j in range(4)])


def angle_of(cosine: Column) -> Column:
    """Degrees; the clip is needed, as rounding can leave the cosine's range. Null stays null (greatest() skips it)."""
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def rotation_distance(a: str | Column, b: str | Column) -> Column:
    """SE3-04: geodesic angle between two rotations in degrees; null if either is null."""
    return angle_of((total([at(a, k, i) * at(b, k, i) for i in range(3) for k in range(3)]) - 1) / 2)


def translation_distance(a: str | Column, b: str | Column) -> Column:
    """SE3-04: distance between the two shifts."""
    return F.sqrt(total([(at(a, i, 3) - at(b, i, 3)) * (at(a, i, 3) - at(b, i, 3)) for i in range(3)]))


def discrepancy(forward: str | Column, backward: str | Column) -> tuple[Column, Column]:
    """SE3-06: (degrees, metres) of ``forward backward`` from the identity; not the distance to an inverse."""
    trace = total([at(forward, i, k) * at(backward, k, i) for i in range(3) for k in range(3)])
    shift = [total([at(forward, i, k) * at(backward, k, 3) for k in range(3)]) + at(forward, i, 3) for i in range(3)]
    return angle_of((trace - 1) / 2), F.sqrt(total([s * s for s in shift]))


def apply(t: str | Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """SE3-05: a moved point."""
    return tuple(at(t, i, 0) * x + at(t, i, 1) * y + at(t, i, 2) * z + at(t, i, 3) for i in range(3))


def is_valid(t: str | Column, atol: float = 2e-4, last_row: float = 1e-8, rtol: float = 1e-5) -> Column:
    """SE3-01: 16 finite values, last row (0, 0, 0, 1), orthonormal rotation of determinant 1. Null is invalid."""
    values = col(t)
    close = lambda x, want, tol: F.abs(x - want) <= tol + rtol * abs(want)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    last = reduce(lambda a, b: a & b, [close(at(t, 3, j), IDENTITY[12 + j], last_row) for j in range(4)])
    gram = reduce(lambda a, b: a & b, [close(total([at(t, k, i) * at(t, k, j) for k in range(3)]), 1.0 * (i == j), atol) for i in range(3) for j in range(3)])
    m = lambda i, j: at(t, i, j)
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    return F.coalesce((F.size(values) == 16) & finite & last & gram & close(det, 1.0, atol), F.lit(False))


def euler_deg(t: str | Column) -> tuple[Column, Column, Column]:
    """SE3-08: x, y, z angles in degrees of ``Rz Ry Rx``."""
    x = F.degrees(F.atan2(at(t, 2, 1), at(t, 2, 2)))
    y = F.degrees(F.atan2(-at(t, 2, 0), F.sqrt(at(t, 0, 0) * at(t, 0, 0) + at(t, 1, 0) * at(t, 1, 0))))
    return x, y, F.degrees(F.atan2(at(t, 1, 0), at(t, 0, 0)))


def grade(rre: Column, rte: Column) -> tuple[Column, Column, Column]:
    """SEM-12: (strict, relaxed, catastrophic); bounds inclusive, null errors are never a success."""
    no = F.lit(False)
    return (F.coalesce((rre <= 5) & (rte <= 0.20), no), F.coalesce((rre <= 10) & (rte <= 0.30), no), F.coalesce((rre > 20) | (rte > 0.50), no))


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def interpolate(a: str | Column, b: str | Column, alpha: Column) -> Column:
    """SE3-07: from a to b at ``alpha`` (clipped to 0..1): the rotation turns about the one axis between them, the
    shift moves on the straight line. Half turns have no single axis and take the one of the skew part."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha))
    zero = F.lit(0.0)

    def axis(r: Column) -> Column:
        """The turn's angle and axis from the nine entries of the relative rotation."""
        e = lambda i, j: F.get(r, F.lit(3 * i + j))
        theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (e(0, 0) + e(1, 1) + e(2, 2) - 1) / 2)))
        return F.array(theta, e(2, 1) - e(1, 2), e(0, 2) - e(2, 0), e(1, 0) - e(0, 1))

    def turn(q: Column) -> Column:
        """The nine entries of the partial rotation."""
        theta = F.get(q, F.lit(0))
        x, y, z = (F.when(F.sin(theta) > 1e-9, F.get(q, F.lit(i)) / (2 * F.sin(theta))).otherwise(0.0) for i in (1, 2, 3))
        skew = [[zero, -z, y], [z, zero, -x], [-y, x, zero]]
        s, c = F.sin(theta * t), 1 - F.cos(theta * t)
        return F.array(*[F.lit(1.0 * (i == j)) + s * skew[i][j] + c * total([skew[i][k] * skew[k][j] for k in range(3)]) for i in range(3) for j in range(3)])

    def placed(r: Column) -> Column:
        rows = [[total([at(a, i, k) * F.get(r, F.lit(3 * k + j)) for k in range(3)]) for j in range(3)] + [at(a, i, 3) + t * (at(b, i, 3) - at(a, i, 3))] for i in range(3)]
        return F.array(*[v for row in rows for v in row], zero, zero, zero, F.lit(1.0))

    relative = F.array(*[total([at(a, k, i) * at(b, k, j) for k in range(3)]) for i in range(3) for j in range(3)])
    return _let(_let(_let(relative, axis), turn), placed)
