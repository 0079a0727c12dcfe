"""Rotations and simple space geometry as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import to_radians


def rotate(point: tuple[Column, Column, Column], angle: Column, origin: tuple, direction: tuple, unit: str = "RAD") -> tuple[Column, Column, Column]:
    """A point turned by an angle about the line through origin along direction."""
    a = to_radians(angle, unit)
    c, s = F.cos(a), F.sin(a)
    o = [F.lit(float(v)) if not isinstance(v, Column) else v for v in origin]
    d = [F.lit(float(v)) if not isinstance(v, Column) else v for v in direction]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    u = [v / size for v in d]
    p = [v - w for v, w in zip(point, o, strict=True)]
    along = (u[0] * p[0] + u[1] * p[1] + u[2] * p[2]) * (1 - c)
    cross = [u[1] * p[2] - u[2] * p[1], u[2] * p[0] - u[0] * p[2], u[0] * p[1] - u[1] * p[0]]
    return tuple(o[k] + p[k] * c + cross[k] * s + u[k] * along for k in range(3))


def rotate_line(p1: tuple, p2: tuple, angle: Column, origin: tuple, direction: tuple, unit: str = "RAD") -> Column:
    """Two rotated points of a line, as a 2 x 3 matrix."""
    both = [F.array(*rotate(p, angle, origin, direction, unit)) for p in (p1, p2)]
    return F.struct(F.lit(2).alias("rows"), F.lit(3).alias("cols"), F.concat(*both).alias("data"))


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a: tuple, b: tuple) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def distance_to_plane(p: tuple, normal: tuple, offset: Column) -> Column:
    """Of a point from the plane normal . x + offset = 0."""
    return F.abs(dot(p, normal) + offset) / norm(normal)
