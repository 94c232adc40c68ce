"""Boxes, vectors and rotations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]
TINY = 1e-6


def _named(prefix: str) -> Box:
    return [F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2")]


def box(prefix: str = "") -> Box:
    return _named(prefix)


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0])


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[3] - b[1])


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) * 0.5, (b[1] + b[3]) * 0.5


def area(b: Box) -> Column:
    return width(b) * height(b)


def diagonal(b: Box) -> Column:
    return F.hypot(width(b), height(b))


def aspect_ratio(b: Box) -> Column:
    return width(b) / F.greatest(height(b), F.lit(1e-6))


def iou(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def center_distance_ratio(a: Box, b: Box, frame_width: Column, frame_height: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    one = F.lit(1.0)
    return F.hypot((ax - bx) / F.greatest(one, frame_width), (ay - by) / F.greatest(one, frame_height))


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def rotation_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation of a quaternion; a zero quaternion is the identity."""
    n = norm(w, x, y, z)
    unit = [F.when(n > 0, c / n).otherwise(d) for c, d in ((w, 1.0), (x, 0.0), (y, 0.0), (z, 0.0))]
    w, x, y, z = unit
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotate(matrix: list[list[Column]], v: Sequence[Column], inverse: bool = False) -> list[Column]:
    rows = list(zip(*matrix)) if inverse else matrix
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in rows]


def world_velocity(vx, vz, ego_vx, ego_vz, yaw_rate, dx, dz) -> tuple[Column, Column]:
    """Object velocity plus ego velocity plus the effect of the ego turn."""
    return vx + ego_vx - yaw_rate * dz, vz + ego_vz + yaw_rate * dx


def closing_speed(vx, vz, ego_vx, ego_vz, dx, dz) -> Column:
    distance = norm(dx, dz) + 1e-5
    return -((vx - ego_vx) * dx + (vz - ego_vz) * dz) / distance


def direction_error_degrees(a: Sequence[Column], b: Sequence[Column]) -> Column:
    cosine = (a[0] * b[0] + a[1] * b[1]) / F.greatest(norm(*a) * norm(*b), F.lit(TINY))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def magnitude_ratio(a: Sequence[Column], b: Sequence[Column]) -> Column:
    na, nb = norm(*a), norm(*b)
    return F.greatest(na, nb, F.lit(TINY)) / F.greatest(F.least(na, nb), F.lit(TINY))
