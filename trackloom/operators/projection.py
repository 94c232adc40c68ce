"""Oriented boxes in space to boxes in the image."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_boxes(
    df: DataFrame, size: tuple[float, float, float], focal: float, principal: tuple[float, float]
) -> DataFrame:
    """Image bounds of the box corners in front of the camera; boxes wholly behind it are dropped.

    The eight corners are an array within the row, so nothing is shuffled.
    """
    l, h, w = (s / 2 for s in size)
    corners = F.array(
        *[
            F.struct((F.col("x") + sx * l).alias("x"), (F.col("y") + sy * h).alias("y"), (F.col("z") + sz * w).alias("z"))
            for sx, sy, sz in product((-1, 1), repeat=3)
        ]
    )
    visible = F.filter("corners", lambda c: c["z"] > 0)
    u = F.transform("visible", lambda c: c["x"] / c["z"] * focal + principal[0])
    v = F.transform("visible", lambda c: c["y"] / c["z"] * focal + principal[1])
    return (
        df.withColumn("corners", corners)
        .withColumn("visible", visible)
        .filter(F.size("visible") > 0)
        .select(
            *df.columns,
            F.array_min(u).alias("x1"),
            F.array_min(v).alias("y1"),
            F.array_max(u).alias("x2"),
            F.array_max(v).alias("y2"),
        )
        .drop("x", "y", "z")
    )
