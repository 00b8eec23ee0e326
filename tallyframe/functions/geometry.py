"""Plane geometry of strokes and boxes as Column arithmetic; points are struct<x, y>, boxes struct<x0, y0, x1, y1>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside(p: Column, box: Column, slack: float = 0.0) -> Column:
    return p["x"].between(box["x0"] - slack, box["x1"] + slack) & p["y"].between(box["y0"] - slack, box["y1"] + slack)


def distance(p: Column, box: Column) -> Column:
    """From a point to the nearest point of a box."""
    dx = F.greatest(box["x0"] - p["x"], F.lit(0.0), p["x"] - box["x1"])
    dy = F.greatest(box["y0"] - p["y"], F.lit(0.0), p["y"] - box["y1"])
    return F.hypot(dx, dy)


def center(box: Column) -> Column:
    return F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))


def segment_hits(a: Column, b: Column, box: Column) -> Column:
    """The segment has a point in the box: its parameter intervals on both axes overlap within [0, 1]."""
    low, high, apart = F.lit(0.0), F.lit(1.0), F.lit(False)
    for axis in ("x", "y"):
        step = b[axis] - a[axis]
        s, t = ((box[f"{axis}{i}"] - a[axis]) / F.nullif(step, F.lit(0.0)) for i in (0, 1))
        low = F.greatest(low, F.when(step != 0, F.least(s, t)).otherwise(low))
        high = F.least(high, F.when(step != 0, F.greatest(s, t)).otherwise(high))
        apart = apart | ((step == 0) & ~a[axis].between(box[f"{axis}0"], box[f"{axis}1"]))
    return ~apart & (low <= high)


def stroke_touches(points: Column, box: Column) -> Column:
    """Any point in the box or any segment through it."""
    n = F.size(points)
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(points, i).alias("a"), F.try_element_at(points, i + 1).alias("b"))))
    return F.exists(points, lambda p: inside(p, box)) | F.coalesce(F.exists(steps, lambda s: segment_hits(s["a"], s["b"], box)), F.lit(False))


def stroke_distance(points: Column, box: Column) -> Column:
    return F.array_min(F.transform(points, lambda p: distance(p, box)))


def side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Proper crossing of two segments."""
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def bounds(points: Column) -> Column:
    xs, ys = (F.transform(points, lambda p, k=k: p[k]) for k in ("x", "y"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def path_length(points: Column) -> Column:
    n = F.size(points)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.hypot(F.try_element_at(points, i + 1)["x"] - F.try_element_at(points, i)["x"], F.try_element_at(points, i + 1)["y"] - F.try_element_at(points, i)["y"]), F.lit(0.0)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def symbol_of(n_strokes: Column, crossing: Column, closed: Column, slope: Column) -> Column:
    """√, ×, △, / or null from stroke features: a crossing pair, a closed path, a rising line, or a turn."""
    return F.when((n_strokes == 2) & crossing, "×").when(closed, "△").when((n_strokes == 1) & (slope > 0.5), "/").when((n_strokes == 1) & (slope <= 0.5), "√")
