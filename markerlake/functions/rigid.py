"""Rotations and rigid motions as columns: quaternions (w, x, y, z), plane poses (x, y, angle) and 4x4 matrices of
sixteen numbers, row by row, all arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound
from .scalars import mod2pi


def _at(a: Column, n: int) -> list[Column]:
    return [F.get(a, F.lit(k)) for k in range(n)]


def vec(*values) -> Column:
    return F.array(*(v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in values))


@bound
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@bound
def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@bound
def scaled(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


@bound
def normalized(a: Column) -> Column:
    return scaled(a, 1 / magnitude(a))


@bound
def cross(a: Column, b: Column) -> Column:
    x, y = _at(a, 3), _at(b, 3)
    return vec(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


@bound
def quat_multiply(a: Column, b: Column) -> Column:
    (aw, ax, ay, az), (bw, bx, by, bz) = _at(a, 4), _at(b, 4)
    return vec(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


@bound
def quat_conjugate(q: Column) -> Column:
    w, x, y, z = _at(q, 4)
    return vec(w, -x, -y, -z)


@bound
def quat_inverse(q: Column) -> Column:
    """The conjugate over the squared magnitude, which inverts any quaternion but zero."""
    return scaled(quat_conjugate(q), 1 / dot(q, q))


@bound
def quat_rotate(q: Column, v: Column) -> Column:
    w, x, y, z = _at(quat_multiply(quat_multiply(q, F.concat(vec(0), v)), quat_conjugate(q)), 4)
    return vec(x, y, z)


@bound
def angleaxis_to_quat(angle: Column, axis: Column) -> Column:
    x, y, z = _at(normalized(axis), 3)
    s = F.sin(angle / 2)
    return vec(F.cos(angle / 2), x * s, y * s, z * s)


@bound
def quat_to_angle(q: Column) -> Column:
    """Of a unit quaternion, in [-pi, pi)."""
    return mod2pi(2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get(q, F.lit(0))))))


@bound
def quat_to_axis(q: Column) -> Column:
    """Of a unit quaternion; zero where it turns nothing."""
    axis = F.slice(q, 2, 3)
    return F.when(magnitude(axis) < 1e-12, vec(0, 0, 0)).otherwise(normalized(axis))


@bound
def rpy_to_quat(roll: Column, pitch: Column, yaw: Column) -> Column:
    axes = [vec(1, 0, 0), vec(0, 1, 0), vec(0, 0, 1)]
    r, p, y = (angleaxis_to_quat(a, axis) for a, axis in zip((roll, pitch, yaw), axes))
    return quat_multiply(y, quat_multiply(p, r))


@bound
def quat_to_rpy(q: Column) -> Column:
    """Roll, pitch and yaw of a unit quaternion."""
    w, x, y, z = _at(q, 4)
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - x * z))))
    return vec(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), pitch, F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


@bound
def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc; straight, and normalised again, where the two are near."""
    c = dot(a, b)
    near_b = F.when(c < 0, scaled(b, -1.0)).otherwise(b)
    angle = F.acos(F.least(F.lit(1.0), F.abs(c)))
    wa, wb = F.when(F.abs(c) > 0.9995, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle)), F.when(F.abs(c) > 0.9995, t).otherwise(F.sin(t * angle) / F.sin(angle))
    return normalized(F.zip_with(a, near_b, lambda x, y: x * wa + y * wb))


@bound
def quat_to_mat44(q: Column, xyz: Column | None = None) -> Column:
    w, x, y, z = _at(q, 4)
    tx, ty, tz = _at(xyz, 3) if xyz is not None else (F.lit(0.0),) * 3
    return vec(
        w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y), tx, 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x), ty,
        2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z, tz, 0, 0, 0, 1,
    )


@bound
def mat44_to_quat(m: Column) -> Column:
    """Of a rotation matrix; the largest component is taken first, so none is divided by a small number."""
    a = _at(m, 12)
    r = [[a[4 * i + j] for j in range(3)] for i in range(3)]
    t = r[0][0] + r[1][1] + r[2][2]
    cases = [
        (t, (1 + t, r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1])),
        (r[0][0], (r[2][1] - r[1][2], 1 + r[0][0] - r[1][1] - r[2][2], r[0][1] + r[1][0], r[0][2] + r[2][0])),
        (r[1][1], (r[0][2] - r[2][0], r[0][1] + r[1][0], 1 - r[0][0] + r[1][1] - r[2][2], r[1][2] + r[2][1])),
        (r[2][2], (r[1][0] - r[0][1], r[0][2] + r[2][0], r[1][2] + r[2][1], 1 - r[0][0] - r[1][1] + r[2][2])),
    ]
    top, found = F.greatest(*(c for c, _ in cases)), vec(*cases[3][1])
    for c, q in cases[2::-1]:
        found = F.when(c == top, vec(*q)).otherwise(found)
    return normalized(found)


@bound
def mat44_multiply(a: Column, b: Column) -> Column:
    x, y = _at(a, 16), _at(b, 16)
    return vec(*(sum((x[4 * i + k] * y[4 * k + j] for k in range(1, 4)), x[4 * i] * y[j]) for i in range(4) for j in range(4)))


@bound
def mat44_transform(m: Column, p: Column) -> Column:
    a, (x, y, z) = _at(m, 12), _at(p, 3)
    return vec(*(a[4 * i] * x + a[4 * i + 1] * y + a[4 * i + 2] * z + a[4 * i + 3] for i in range(3)))


@bound
def mat44_rotate(m: Column, v: Column) -> Column:
    a, (x, y, z) = _at(m, 12), _at(v, 3)
    return vec(*(a[4 * i] * x + a[4 * i + 1] * y + a[4 * i + 2] * z for i in range(3)))


@bound
def mat44_inverse(m: Column) -> Column:
    """Of a rigid motion: the turned-back rotation and translation."""
    a = _at(m, 12)
    r = [[a[4 * j + i] for j in range(3)] for i in range(3)]
    t = [-(r[i][0] * a[3] + r[i][1] * a[7] + r[i][2] * a[11]) for i in range(3)]
    return vec(*r[0], t[0], *r[1], t[1], *r[2], t[2], 0, 0, 0, 1)


def translation(x, y, z) -> Column:
    return vec(1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, z, 0, 0, 0, 1)


@bound
def xyt_multiply(a: Column, b: Column) -> Column:
    """Plane motion a, then b within a's frame."""
    (ax, ay, at), (bx, by, bt) = _at(a, 3), _at(b, 3)
    return vec(F.cos(at) * bx - F.sin(at) * by + ax, F.sin(at) * bx + F.cos(at) * by + ay, at + bt)


@bound
def xyt_inverse(a: Column) -> Column:
    x, y, t = _at(a, 3)
    return vec(-(F.cos(t) * x + F.sin(t) * y), F.sin(t) * x - F.cos(t) * y, -t)


@bound
def xyt_transform(a: Column, p: Column) -> Column:
    (x, y, t), (px, py) = _at(a, 3), _at(p, 2)
    return vec(F.cos(t) * px - F.sin(t) * py + x, F.sin(t) * px + F.cos(t) * py + y)


@bound
def xyt_to_mat44(a: Column) -> Column:
    x, y, t = _at(a, 3)
    return vec(F.cos(t), -F.sin(t), 0, x, F.sin(t), F.cos(t), 0, y, 0, 0, 1, 0, 0, 0, 0, 1)


@bound
def mat44_to_xyt(m: Column) -> Column:
    a = _at(m, 8)
    return vec(a[3], a[7], F.atan2(a[4], a[0]))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(subtracted(a, b), F.lit(0.0), lambda s, x: s + x * x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


@bound
def cross_matrix(a: Column) -> Column:
    """The 3x3 matrix whose product with b is the cross product of a and b."""
    x, y, z = _at(a, 3)
    return vec(0, -z, y, z, 0, -x, -y, x, 0)


@bound
def mat_product(a: Column, b: Column, rows: int, inner: int, cols: int, turn_a: bool = False, turn_b: bool = False) -> Column:
    """a (rows x inner) times b (inner x cols), either given as its transpose; cols = 1 takes a vector."""
    left = lambda i, k: F.get(a, F.lit(k * rows + i if turn_a else i * inner + k))
    right = lambda k, j: F.get(b, F.lit(j * inner + k if turn_b else k * cols + j))
    cell = lambda i, j: sum((left(i, k) * right(k, j) for k in range(1, inner)), left(i, 0) * right(0, j))
    return vec(*(cell(i, j) for i in range(rows) for j in range(cols)))


def angleaxis_to_mat44(angle: Column, axis: Column) -> Column:
    return quat_to_mat44(angleaxis_to_quat(angle, axis))


def rpy_to_mat44(roll: Column, pitch: Column, yaw: Column) -> Column:
    return quat_to_mat44(rpy_to_quat(roll, pitch, yaw))


@bound
def xyzrpy_to_mat44(v: Column) -> Column:
    x, y, z, roll, pitch, yaw = _at(v, 6)
    return quat_to_mat44(rpy_to_quat(roll, pitch, yaw), vec(x, y, z))


@bound
def mat44_to_xyz(m: Column) -> Column:
    return vec(*(F.get(m, F.lit(k)) for k in (3, 7, 11)))


def quat_xyz_to_xyt(q: Column, xyz: Column) -> Column:
    return mat44_to_xyt(quat_to_mat44(q, xyz))


def xyt_inverse_multiply(a: Column, b: Column) -> Column:
    """b as seen from a."""
    return xyt_multiply(xyt_inverse(a), b)


def identity44() -> Column:
    return translation(0, 0, 0)


def scaling(x, y, z) -> Column:
    return vec(x, 0, 0, 0, 0, y, 0, 0, 0, 0, z, 0, 0, 0, 0, 1)


@bound
def rotation(angle: Column, axis: str) -> Column:
    """About the axis x, y or z; mat44_multiply(m, rotation(...)) turns within m's frame."""
    c, s = F.cos(angle), F.sin(angle)
    return {"x": vec(1, 0, 0, 0, 0, c, -s, 0, 0, s, c, 0, 0, 0, 0, 1), "y": vec(c, 0, s, 0, 0, 1, 0, 0, -s, 0, c, 0, 0, 0, 0, 1), "z": vec(c, -s, 0, 0, s, c, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)}[axis]


def mat44_inverse_transform(m: Column, p: Column) -> Column:
    return mat44_transform(mat44_inverse(m), p)


def mat44_inverse_rotate(m: Column, v: Column) -> Column:
    return mat44_rotate(mat44_inverse(m), v)


@bound
def look_at(eye: Column, target: Column, up: Column) -> Column:
    """Pose of a camera at eye that looks along its negative z axis at target, its y axis as near to up as that allows."""
    back = normalized(subtracted(eye, target))

    def framed(z: Column) -> Column:
        side = normalized(cross(up, z))
        return F.get(F.transform(F.array(F.struct(side.alias("x"), cross(z, side).alias("y"))), lambda f: vec(*(v for k in range(3) for v in (F.get(f["x"], F.lit(k)), F.get(f["y"], F.lit(k)), F.get(z, F.lit(k)), F.get(eye, F.lit(k)))), 0, 0, 0, 1)), F.lit(0))

    return F.get(F.transform(F.array(back), framed), F.lit(0))


def _carried(j: Column, cov: Column) -> Column:
    """j cov j' of 3x3 matrices."""
    return mat_product(mat_product(j, cov, 3, 3, 3), j, 3, 3, 3, turn_b=True)


@bound
def xytcov_multiply(a: Column, cov_a: Column, b: Column, cov_b: Column) -> Column:
    """struct(xyt, cov) of a, then b, with uncertainties that do not depend on each other."""
    t, (x, y) = F.get(a, F.lit(2)), _at(b, 2)
    c, s = F.cos(t), F.sin(t)
    by_a, by_b = vec(1, 0, -s * x - c * y, 0, 1, c * x - s * y, 0, 0, 1), vec(c, -s, 0, s, c, 0, 0, 0, 1)
    return F.struct(xyt_multiply(a, b).alias("xyt"), added(_carried(by_a, cov_a), _carried(by_b, cov_b)).alias("cov"))


@bound
def xytcov_inverse(a: Column, cov: Column) -> Column:
    x, y, t = _at(a, 3)
    c, s = F.cos(t), F.sin(t)
    return F.struct(xyt_inverse(a).alias("xyt"), _carried(vec(-c, -s, s * x - c * y, s, -c, c * x + s * y, 0, 0, -1), cov).alias("cov"))


@bound
def chol33(m: Column) -> Column:
    """Lower l with l l' = m, for a symmetric positive definite 3x3 m; NaN where it is not."""
    g = lambda a, k: F.get(a, F.lit(k))
    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    first = vec(F.sqrt(g(m, 0)), g(m, 3) / F.sqrt(g(m, 0)), g(m, 6) / F.sqrt(g(m, 0)))

    def second(a: Column) -> Column:
        d = F.sqrt(g(m, 4) - g(a, 1) * g(a, 1))
        return one(vec(d, (g(m, 7) - g(a, 1) * g(a, 2)) / d), lambda b: vec(g(a, 0), 0, 0, g(a, 1), g(b, 0), 0, g(a, 2), g(b, 1), F.sqrt(g(m, 8) - g(a, 2) * g(a, 2) - g(b, 1) * g(b, 1))))

    return one(first, second)


@bound
def lower_inverse33(m: Column) -> Column:
    a, b, c, d, e, f = (F.get(m, F.lit(k)) for k in (0, 3, 4, 6, 7, 8))
    return vec(1 / a, 0, 0, -b / (a * c), 1 / c, 0, (b * e - c * d) / (a * c * f), -e / (c * f), 1 / f)


@bound
def solve_symmetric33(m: Column, b: Column) -> Column:
    """x of m x = b, through the Cholesky factor."""
    i = lower_inverse33(chol33(m))
    return F.get(F.transform(F.array(i), lambda u: mat_product(u, mat_product(u, b, 3, 3, 1), 3, 3, 1, turn_a=True)), F.lit(0))
