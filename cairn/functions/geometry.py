"""Vectors, distances, projections, angles and small eigenproblems as column expressions.

A point or vector is a tuple of columns, so everything stays inside generated code.  Quotients
whose divisor may be zero use ``try_divide`` and state what they give then.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
GON_PER_RADIAN = 200 / math.pi


def vec(*names: str, prefix: str = "") -> Vec:
    return tuple(F.col(prefix + n) for n in (names or ("x", "y", "z")))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda s, t: s + t, [p * q for p, q in zip(a, b, strict=True)])


def squared_norm(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(squared_norm(a))


def max_norm(a: Vec) -> Column:
    return F.greatest(*[F.abs(p) for p in a])


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def cross2(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def squared_distance(a: Vec, b: Vec) -> Column:
    return squared_norm(sub(a, b))


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(squared_distance(a, b))


def plane_distance(p: Vec, origin: Vec, normal: Vec) -> Column:
    """Unsigned; null for a zero normal."""
    return F.abs(F.try_divide(dot(sub(p, origin), normal), norm(normal)))


def line_distance(p: Vec, origin: Vec, direction: Vec) -> Column:
    """Null for a zero direction."""
    return F.try_divide(norm(cross(sub(p, origin), direction)), norm(direction))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """To the nearest point of the segment; its ends if they coincide."""
    d = sub(b, a)
    t = F.least(F.greatest(F.coalesce(F.try_divide(dot(sub(p, a), d), squared_norm(d)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return distance(p, add(a, scale(d, t)))


def project_on_line(p: Vec, origin: Vec, direction: Vec) -> Vec:
    t = F.try_divide(dot(sub(p, origin), direction), squared_norm(direction))
    return add(origin, scale(direction, t))


def project_on_plane(p: Vec, origin: Vec, normal: Vec) -> Vec:
    t = F.try_divide(dot(sub(p, origin), normal), squared_norm(normal))
    return sub(p, scale(normal, t))


def project_on_sphere(p: Vec, centre: Vec, radius) -> Vec:
    """The centre itself goes to the pole of the last axis."""
    d = sub(p, centre)
    n = norm(d)
    pole = [F.lit(0.0)] * (len(p) - 1) + [F.lit(1.0)]
    return tuple(c + F.when(n == 0, u).otherwise(F.try_divide(q, n)) * radius for c, q, u in zip(centre, d, pole, strict=True))


def angle_2d(v: Vec) -> Column:
    """In [0, 2 pi)."""
    a = F.atan2(v[1], v[0])
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def angle_between(a: Vec, b: Vec) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.acos(clamp(F.try_divide(dot(a, b), n), -1.0, 1.0)))


def clamp(v: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(F.least(v, high), low)


def transform(p: Vec, m: list[float]) -> Vec:
    """A rigid transform by a row-major 4x4 matrix of numbers."""
    return tuple(p[0] * m[4 * i] + p[1] * m[4 * i + 1] + p[2] * m[4 * i + 2] + m[4 * i + 3] for i in range(3))


def euler_angles(m: list[Column]) -> Vec:
    """(Rx, Ry, Rz) of a row-major rotation, z-y-x order; at the poles Rz is 0."""
    m00, m01, m02, m10, _, _, m20, m21, m22 = m
    y = -F.asin(clamp(m20, -1.0, 1.0))
    c = F.cos(y)
    x = F.atan2(F.try_divide(m21, c), F.try_divide(m22, c))
    z = F.atan2(F.try_divide(m10, c), F.try_divide(m00, c))
    return (
        F.when(m20 == -1, F.atan2(m01, m02)).when(m20 == 1, F.atan2(-m01, -m02)).otherwise(x),
        F.when(m20 == -1, F.lit(math.pi / 2)).when(m20 == 1, F.lit(-math.pi / 2)).otherwise(y),
        F.when(F.abs(m20) == 1, F.lit(0.0)).otherwise(z),
    )


def eigenvalues2(a: Column, b: Column, c: Column) -> Vec:
    """Of [[a, b], [b, c]], descending."""
    mid, half = (a + c) / 2, F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    return (mid + half, mid - half)


def eigenvalue_steps(s: Vec) -> list[dict[str, Column]]:
    """Columns _q, _p, _det, _phi, l1, l2, l3 in steps, each using those before it.

    The eigenvalues l1 >= l2 >= l3 of the symmetric matrix (xx, xy, xz, yy, yz, zz) by the
    trigonometric form.  Steps keep the expressions small: one nested expression would repeat its
    parts many times over.
    """
    xx, xy, xz, yy, yz, zz = s
    q, p, det, phi = (F.col(c) for c in ("_q", "_p", "_det", "_phi"))
    a, b, c = xx - q, yy - q, zz - q
    return [
        {"_q": (xx + yy + zz) / 3},
        {"_p": F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6), "_det": a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)},
        {"_phi": F.acos(clamp(F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0)), -1.0, 1.0)) / 3},
        {"l1": q + 2 * p * F.cos(phi), "l3": q + 2 * p * F.cos(phi + 2 * math.pi / 3)},
        {"l2": 3 * q - F.col("l1") - F.col("l3")},
    ]


def eigenvector_steps(s: Vec, value: Column, names: tuple[str, str, str]) -> list[dict[str, Column]]:
    """A unit eigenvector in steps (as eigenvalue_steps): the longest cross product of two rows of the shifted matrix.

    (0, 0, 1) where all are zero (isotropic spreads).  The component of largest size is
    positive, so the sign is the same on every engine.
    """
    xx, xy, xz, yy, yz, zz = s
    rows = ((xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value))
    options = [F.struct(squared_norm(c).alias("n"), *[q.alias(k) for q, k in zip(c, "abc", strict=True)]) for c in (cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))]
    best, length = F.col("_best"), F.col("_length")
    unit = tuple(F.col(n) for n in ("_u", "_v", "_w"))
    return [
        {"_best": F.greatest(*options)},
        {"_length": F.sqrt(best["n"])},
        {n: F.when(length <= 0, F.lit(d)).otherwise(F.try_divide(best[k], length)) for n, k, d in zip(("_u", "_v", "_w"), "abc", (0.0, 0.0, 1.0), strict=True)},
        {"_sign": upright_sign(unit)},
        {n: u * F.col("_sign") for n, u in zip(names, unit, strict=True)},
    ]


def upright_sign(v: Vec) -> Column:
    """1 or -1, so that the vector's component of largest size becomes positive."""
    x, y, z = v
    lead = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), x).when(F.abs(y) >= F.abs(z), y).otherwise(z)
    return F.when(lead < 0, -1.0).otherwise(1.0)


def circumcentre(a: Vec, b: Vec, c: Vec) -> Vec:
    """Of a triangle in the plane; null if its corners are in line."""
    d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    p, q, r = squared_norm(a), squared_norm(b), squared_norm(c)
    return (
        F.try_divide(p * (b[1] - c[1]) + q * (c[1] - a[1]) + r * (a[1] - b[1]), d),
        F.try_divide(p * (c[0] - b[0]) + q * (a[0] - c[0]) + r * (b[0] - a[0]), d),
    )


def triangle_area_2d(a: Vec, b: Vec, c: Vec) -> Column:
    return F.abs(cross2(sub(b, a), sub(c, a))) / 2


def triangle_area_3d(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def same_ring(a: Column, b: Column) -> Column:
    """Whether two arrays of vertices are the same polygon: equal after turning one of them."""
    n = F.size(a)
    turned = lambda k: F.concat(F.slice(a, k + 1, n - k), F.slice(a, 1, k)) == b
    return F.when(n != F.size(b), F.lit(False)).when(n == 0, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), n - 1), turned))


def patch_metric(n1: Vec, n2: Vec, p1: Vec, p2: Vec, resolution: float, weight: float = 0.4) -> Column:
    """Difference of two oriented points: of direction, and of place in units of the resolution."""
    return 1 - F.abs(dot(n1, n2)) + weight * distance(p1, p2) / resolution


def voxel_seed_metric(n1: Vec, n2: Vec, p1: Vec, p2: Vec, seed_resolution: float) -> Column:
    return 1.0 * (1 - F.abs(dot(n1, n2))) + 0.5 * distance(p1, p2) / seed_resolution


def gray(r: Column, g: Column, b: Column) -> Column:
    """Integer luminance: eleven, sixteen and five parts of 32."""
    return F.floor((r * 11 + g * 16 + b * 5) / 32).cast("int")


def pack_rgb(r: Column, g: Column, b: Column, alpha: Column | None = None) -> Column:
    """A signed 32-bit colour, alpha first."""
    value = F.shiftleft((F.lit(255) if alpha is None else alpha).cast("long"), 24).bitwiseOR(F.shiftleft(r.cast("long"), 16)).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def unpack_rgb(c: Column) -> tuple[Column, Column, Column, Column]:
    """(alpha, red, green, blue)."""
    v = c.cast("long")
    return tuple(F.shiftright(v, s).bitwiseAND(255).cast("int") for s in (24, 16, 8, 0))


def floor_log2(n: Column) -> Column:
    """Exact for positive integers: the number of binary digits less one."""
    return F.length(F.bin(n)) - 1


def ceil_log2(n: Column) -> Column:
    return F.when(n == 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def floor_power2(n: Column) -> Column:
    return F.pow(F.lit(2.0), floor_log2(n)).cast("long")


def ceil_power2(n: Column) -> Column:
    return F.pow(F.lit(2.0), ceil_log2(n)).cast("long")
