"""Quaternions (x, y, z, w), rotation matrices (row-major 9) and basis changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, let, norm, parts, scaled, vec

# Smallest rotation angle, near-parallel limit, units per metre.
SMALL_ANGLE = 1e-12
PARALLEL_DOT = 0.9995
ENGINE_UNITS = 100.0

IDENTITY = (0.0, 0.0, 0.0, 1.0)


def unit(q: Column, n: int = 4) -> Column:
    return let(q, lambda v: scaled(v, F.lit(1.0) / norm(v, n), n))


def axis_angle_to_quat(v: Column) -> Column:
    """Rotation vector to unit quaternion; a vanishing angle gives the identity."""
    def turn(angle):
        k = F.sin(angle / 2) / angle
        x, y, z = parts(v)
        return F.when(angle < SMALL_ANGLE, vec(*IDENTITY)).otherwise(
            F.array(x * k, y * k, z * k, F.cos(angle / 2)))

    return let(norm(v), turn)


def quat_to_axis_angle(q: Column) -> Column:
    """Unit quaternion to rotation vector with angle in [0, pi]."""
    def turn(u):
        x, y, z, w = parts(u, 4)
        sign = F.when(w < 0, -1.0).otherwise(1.0)

        def scale(length):
            k = sign * 2 * F.atan2(length, w * sign) / length
            return F.when(length < SMALL_ANGLE, vec(0, 0, 0)).otherwise(F.array(x * k, y * k, z * k))

        return let(F.sqrt(x * x + y * y + z * z), scale)

    return let(q, turn)


def quat_to_matrix(q: Column) -> Column:
    x, y, z, w = parts(q, 4)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def _unscaled_quat(m: Column) -> tuple[list[Column], list[Column]]:
    """(conditions, candidates): the first condition that holds names its candidate, the last one has none."""
    g = m.getItem
    trace = g(0) + g(4) + g(8)
    t_x, t_y, t_z = 1 + g(0) - g(4) - g(8), 1 - g(0) + g(4) - g(8), 1 - g(0) - g(4) + g(8)
    return ([trace >= F.greatest(g(0), g(4), g(8)), (g(0) >= g(4)) & (g(0) >= g(8)), g(4) >= g(8)],
            [F.array(g(7) - g(5), g(2) - g(6), g(3) - g(1), 1 + trace), F.array(t_x, g(1) + g(3), g(2) + g(6), g(7) - g(5)),
             F.array(g(1) + g(3), t_y, g(5) + g(7), g(2) - g(6)), F.array(g(2) + g(6), g(5) + g(7), t_z, g(3) - g(1))])


def unscaled_quat(m: Column) -> list[Column]:
    """The four numbers of a quaternion along the rotation ``m``, of any length and sign."""
    conditions, candidates = _unscaled_quat(m)

    def number(i: int) -> Column:
        chosen = F.when(conditions[0], candidates[0].getItem(i))
        for condition, c in zip(conditions[1:], candidates[1:]):
            chosen = chosen.when(condition, c.getItem(i))
        return chosen.otherwise(candidates[-1].getItem(i))

    return [number(i) for i in range(4)]


def matrix_to_quat(m: Column) -> Column:
    """Proper rotation to a unit quaternion with w >= 0, via the largest component."""
    conditions, candidates = _unscaled_quat(m)
    raw = F.when(conditions[0], candidates[0]).when(conditions[1], candidates[1]).when(conditions[2], candidates[2]).otherwise(candidates[3])
    return let(unit(raw), lambda q: scaled(q, F.when(q.getItem(3) < 0, -1.0).otherwise(1.0), 4))


def quat_mul(a: Column, b: Column) -> Column:
    """Composition: rotate by ``b`` first, then by ``a``."""
    ax, ay, az, aw = parts(a, 4)
    bx, by, bz, bw = parts(b, 4)
    return F.array(
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz)


def quat_conj(q: Column) -> Column:
    x, y, z, w = parts(q, 4)
    return F.array(-x, -y, -z, w)


def slerp(first: Column, second: Column, alpha: Column) -> Column:
    """Shortest-path spherical interpolation of two quaternions, unit result."""
    def weights(c):
        """(weight of first, weight of second) for the cosine ``c`` of the raw pair."""
        sign = F.when(c < 0, -1.0).otherwise(1.0)
        near = F.abs(c) > PARALLEL_DOT
        angle = F.acos(F.least(F.abs(c), F.lit(1.0)))
        return F.array(
            F.when(near, 1 - alpha).otherwise(F.sin((1 - alpha) * angle) / F.sin(angle)),
            sign * F.when(near, alpha).otherwise(F.sin(alpha * angle) / F.sin(angle)))

    def mixed(pair):
        a, b = pair.getItem(0), pair.getItem(1)
        return let(let(dot(a, b, 4), weights), lambda w: unit(F.array(*[
            w.getItem(0) * a.getItem(i) + w.getItem(1) * b.getItem(i) for i in range(4)])))

    return let(F.array(unit(first), unit(second)), mixed)


# Basis changes. Each pair is mutually inverse.

def camera_to_engine(p: Column) -> Column:
    x, y, z = parts(p)
    return F.array(z * ENGINE_UNITS, x * ENGINE_UNITS, -y * ENGINE_UNITS)


def engine_to_camera(p: Column) -> Column:
    x, y, z = parts(p)
    return F.array(y / ENGINE_UNITS, -z / ENGINE_UNITS, x / ENGINE_UNITS)


def model_to_engine(p: Column) -> Column:
    x, y, z = parts(p)
    return F.array(z * ENGINE_UNITS, x * ENGINE_UNITS, y * ENGINE_UNITS)


def engine_to_model(p: Column) -> Column:
    x, y, z = parts(p)
    return F.array(y / ENGINE_UNITS, z / ENGINE_UNITS, x / ENGINE_UNITS)


def camera_rotation_to_engine(q: Column) -> Column:
    """The basis change has determinant -1, so the vector part flips sign as a whole."""
    x, y, z, w = parts(q, 4)
    return F.array(-z, -x, y, w)


def engine_rotation_to_camera(q: Column) -> Column:
    x, y, z, w = parts(q, 4)
    return F.array(-y, z, -x, w)


def model_rotation_to_engine(q: Column) -> Column:
    x, y, z, w = parts(q, 4)
    return F.array(z, x, y, w)


def engine_rotation_to_model(q: Column) -> Column:
    x, y, z, w = parts(q, 4)
    return F.array(y, z, x, w)


def mirror_position(p: Column) -> Column:
    x, y, z = parts(p)
    return F.array(-x, y, z)


def mirror_rotation(m: Column) -> Column:
    """F * R * F with F = diag(-1, 1, 1) on a row-major matrix."""
    g = m.getItem
    return F.array(g(0), -g(1), -g(2), -g(3), g(4), g(5), -g(6), g(7), g(8))
