"""Rotations as columns: quaternions (x, y, z, w), rotation vectors, matrices as row lists, six-number forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from framewright.functions.vectors import dot, norm

TINY = 1e-12


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, so that nested rotations stay small expressions."""
    return F.get(F.transform(F.array(value), then), 0)


def unit(v: Column) -> Column:
    return let(F.struct(v.alias("v"), norm(v).alias("n")), lambda p: F.transform(p.v, lambda x: F.when(p.n > TINY, x / F.greatest(p.n, F.lit(TINY))).otherwise(x)))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)])


def quat_of_rotvec(v: Column) -> Column:
    """Small angles by the first terms of the series."""
    return let(v, _quat_of_rotvec)


def _quat_of_rotvec(v: Column) -> Column:
    angle = norm(v)
    k = F.when(angle < 1e-6, 0.5 - angle * angle / 48).otherwise(F.sin(angle / 2) / F.greatest(angle, F.lit(1e-6)))
    return F.array(v[0] * k, v[1] * k, v[2] * k, F.cos(angle / 2))


def rotvec_of_quat(q: Column) -> Column:
    """The shorter way round."""
    return let(unit(q), _rotvec_of_quat)


def _rotvec_of_quat(q: Column) -> Column:
    s = F.when(q[3] < 0, -1.0).otherwise(1.0)
    half = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    angle = 2 * F.atan2(half, q[3] * s)
    k = F.when(half < 1e-7, 2.0).otherwise(angle / F.greatest(half, F.lit(1e-7))) * s
    return F.array(q[0] * k, q[1] * k, q[2] * k)


def axis_angle_of_quat(q: Column) -> Column:
    """With w clipped to [-1, 1] and no change of sign; no rotation gives zeros."""
    return let(q, _axis_angle_of_quat)


def _axis_angle_of_quat(q: Column) -> Column:
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q[3]))
    den = F.sqrt(F.greatest(F.lit(0.0), 1 - w * w))
    k = F.when(den < 1e-8, 0.0).otherwise(2 * F.acos(w) / F.greatest(den, F.lit(1e-8)))
    return F.array(q[0] * k, q[1] * k, q[2] * k)


def matrix_of_quat(q: Column) -> Column:
    return let(unit(q), _matrix_of_quat)


def _matrix_of_quat(q: Column) -> Column:
    x, y, z, w = (q[i] for i in range(4))
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def quat_of_matrix(m: Column) -> Column:
    """By the largest of trace and diagonal."""
    return let(m, _quat_of_matrix)


def _quat_of_matrix(m: Column) -> Column:
    e = lambda i, j: m[i][j]
    trace = e(0, 0) + e(1, 1) + e(2, 2)
    root = lambda t: F.sqrt(F.greatest(t, F.lit(TINY))) * 2
    s = root(trace + 1)
    a = F.array((e(2, 1) - e(1, 2)) / s, (e(0, 2) - e(2, 0)) / s, (e(1, 0) - e(0, 1)) / s, s / 4)
    s = root(1 + e(0, 0) - e(1, 1) - e(2, 2))
    b = F.array(s / 4, (e(0, 1) + e(1, 0)) / s, (e(0, 2) + e(2, 0)) / s, (e(2, 1) - e(1, 2)) / s)
    s = root(1 + e(1, 1) - e(0, 0) - e(2, 2))
    c = F.array((e(0, 1) + e(1, 0)) / s, s / 4, (e(1, 2) + e(2, 1)) / s, (e(0, 2) - e(2, 0)) / s)
    s = root(1 + e(2, 2) - e(0, 0) - e(1, 1))
    d = F.array((e(0, 2) + e(2, 0)) / s, (e(1, 2) + e(2, 1)) / s, s / 4, (e(1, 0) - e(0, 1)) / s)
    return F.when(trace > 0, a).when((e(0, 0) > e(1, 1)) & (e(0, 0) > e(2, 2)), b).when(e(1, 1) > e(2, 2), c).otherwise(d)


def composed(p: Column, q: Column) -> Column:
    """First q, then p."""
    return let(F.struct(p.alias("p"), q.alias("q")), lambda c: _composed(c.p, c.q))


def _composed(p: Column, q: Column) -> Column:
    return F.array(
        p[3] * q[0] + p[0] * q[3] + p[1] * q[2] - p[2] * q[1],
        p[3] * q[1] - p[0] * q[2] + p[1] * q[3] + p[2] * q[0],
        p[3] * q[2] + p[0] * q[1] - p[1] * q[0] + p[2] * q[3],
        p[3] * q[3] - p[0] * q[0] - p[1] * q[1] - p[2] * q[2],
    )


def inverse(q: Column) -> Column:
    return let(unit(q), lambda u: F.array(-u[0], -u[1], -u[2], u[3]))


def applied(q: Column, v: Column) -> Column:
    return let(matrix_of_quat(q), lambda m: F.array(*[dot(m[i], v) for i in range(3)]))


def six_of_matrix(m: Column) -> Column:
    """The first two columns."""
    return F.array(*[m[i][j] for j in range(2) for i in range(3)])


def matrix_of_six(s: Column) -> Column:
    """Gram-Schmidt on the two columns; the third is their cross product."""
    rest = lambda a, b: let(F.struct(b.alias("b"), dot(a, b).alias("d")), lambda p: unit(F.zip_with(p.b, a, lambda x, y: x - p.d * y)))
    two = let(unit(F.slice(s, 1, 3)), lambda a: F.struct(a.alias("a"), rest(a, F.slice(s, 4, 3)).alias("b")))
    return let(two, lambda p: let(cross(p.a, p.b), lambda c: F.array(*[F.array(p.a[i], p.b[i], c[i]) for i in range(3)])))


def axis_angle_of_six(s: Column) -> Column:
    return rotvec_of_quat(quat_of_matrix(matrix_of_six(s)))


def binary_gripper(v: Column, threshold: float = 0.5) -> Column:
    return F.when(v > threshold, 1.0).otherwise(-1.0)


def pose_state(position: Column, quat: Column, gripper: Column) -> Column:
    return F.concat(position, axis_angle_of_quat(quat), gripper)
