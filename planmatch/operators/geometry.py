"""Work areas: the convex hull of circles around a permit's poles.

A point inside the hull of others adds nothing to the hull of their circles: batches send only the corners of their own hulls before the
shuffle, so that a group gathers few points however many poles it has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = 64
BUFFER = 50.0


def hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of points, those on its sides left out: the monotone chain algorithm."""
    points = np.unique(points, axis=0)
    if len(points) <= 2:
        return points

    def sweep(ordered: np.ndarray) -> list:
        side: list = []
        for p in ordered:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        return side[:-1]

    return np.array(sweep(points) + sweep(points[::-1]))


def directions(segments: int) -> list[tuple[float, float]]:
    return [(math.cos(2 * math.pi * k / segments), math.sin(2 * math.pi * k / segments)) for k in range(segments)]


def work_areas(poles: DataFrame, keys: list[str], buffer: float = BUFFER, segments: int = SEGMENTS) -> DataFrame:
    """keys and ring (closed, clockwise) of each group of poles (x, y); null keys are a group like others."""
    if buffer <= 0:
        raise ValueError("the buffer must be positive")
    ways = np.array(directions(segments)) * buffer
    kinds = dict(poles.dtypes)
    placed = poles.filter("x is not null and y is not null").select(*keys, F.col("x").cast("double"), F.col("y").cast("double"))

    def reduced(batches):
        """Each batch's groups keep the corners of their own hulls only."""
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                groups.setdefault(key, []).append(i)
            points = np.stack([batch.column(c).to_numpy() for c in "xy"], 1)
            corners = [(own[0], hull(points[own])) for own in groups.values()]
            first = pa.array(np.repeat([i for i, _ in corners], [len(h) for _, h in corners]).astype(np.int64))
            flat = np.concatenate([h for _, h in corners]) if corners else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in keys), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[*keys, "x", "y"])

    def ring(part: pa.Table) -> pa.Table:
        inner = hull(np.stack([part.column(c).to_numpy() for c in "xy"], 1))
        outer = hull((inner[:, None] + ways[None]).reshape(-1, 2))[::-1]
        return pa.table({**{k: part.column(k).slice(0, 1) for k in keys}, "ring": pa.array([[*outer.tolist(), outer[0].tolist()]], pa.list_(pa.list_(pa.float64())))})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return placed.mapInArrow(reduced, f"{schema}, x double, y double").groupBy(*keys).applyInArrow(ring, f"{schema}, ring array<array<double>>")


def measured(areas: DataFrame) -> DataFrame:
    """Work areas with ``area`` and ``perimeter`` of their ring, from differences to its first corner, as coordinates are large beside what they enclose."""
    first = F.get("ring", 0)
    corner = lambda p: F.struct(*((F.get(p, i) - F.get(first, i)).alias(c) for i, c in enumerate("xy")))
    at = F.transform("ring", corner)
    sides = F.zip_with(F.slice(at, 1, F.size("ring") - 1), F.slice(at, 2, F.size("ring") - 1), lambda a, b: F.struct(((b.x * a.y - a.x * b.y) / 2).alias("area"), F.hypot(b.x - a.x, b.y - a.y).alias("length")))
    total = lambda name: F.aggregate(sides, F.lit(0.0), lambda t, x: t + x[name])
    return areas.withColumn("area", total("area")).withColumn("perimeter", total("length"))


def polygons(permits: DataFrame, areas: DataFrame, keys: list[str], wkid: int = 3734) -> DataFrame:
    """Permits with their polygon; permits without poles have none."""
    return permits.join(areas, keys, "left").withColumn("geometry", F.when(F.col("ring").isNotNull(), F.struct(F.array("ring").alias("rings"), F.struct(F.lit(wkid).alias("wkid")).alias("spatialReference")))).drop("ring")
