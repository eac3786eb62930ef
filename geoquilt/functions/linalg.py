"""Vector, rotation and eigenvalue expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded_soon(c: Column, digits: int = 6) -> Column:
    """``rounded`` of a double by plain arithmetic, for results of very many rows.

    What is near a tie, large or no number goes through Spark's decimal rounding, so the values are the same.
    """
    scale = 10.0**digits
    y = c * F.lit(scale)
    plain = (F.abs(y) < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-4)
    return F.when(plain, F.floor(y + 0.5) / F.lit(scale)).otherwise(F.round(c, digits)) + F.lit(0.0)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Vec, b: Vec) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return dot(d, d)


def clipped_acos(c: Column) -> Column:
    """Arc cosine with its argument clipped to [-1, 1]."""
    return F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def euler_rotation(rx: Column, ry: Column, rz: Column, order: str = "XYZ") -> list[list[Column]]:
    """Rotation from angles in degrees, each axis of ``order`` multiplied from the left in turn."""
    one, zero = F.lit(1.0), F.lit(0.0)
    made: dict[str, list[list[Column]]] = {}
    for axis, angle in zip("XYZ", (rx, ry, rz), strict=True):
        c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
        made[axis] = {
            "X": [[one, zero, zero], [zero, c, -s], [zero, s, c]],
            "Y": [[c, zero, s], [zero, one, zero], [-s, zero, c]],
            "Z": [[c, -s, zero], [s, c, zero], [zero, zero, one]],
        }[axis]
    out = made[order[0]]
    for axis in order[1:]:
        out = multiply(made[axis], out)
    return out


def multiply(a: Sequence[Vec], b: Sequence[Vec]) -> list[list[Column]]:
    """Product of two 3 x 3 matrices of columns."""
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def inverse(m: Sequence[Vec]) -> list[list[Column]]:
    """General inverse of a 3 x 3 matrix by its adjugate; rotations read from files need not be orthonormal."""
    minor = lambda r, c: (
        m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    )
    det = sum((m[0][j] * minor(0, j) for j in range(1, 3)), m[0][0] * minor(0, 0))
    return [[minor(c, r) / det for c in range(3)] for r in range(3)]


def apply_rotation(m: Sequence[Vec], p: Vec) -> list[Column]:
    return [dot(row, p) for row in m]


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, descending, in closed trigonometric form."""
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    p2 = a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, det / (2 * p * p * p)).otherwise(0.0)
    phi = clipped_acos(r) / 3
    first = q + 2 * p * F.cos(phi)
    third = q + 2 * p * F.cos(phi + F.lit(2.0943951023931953))
    return [first, 3 * q - first - third, third]
