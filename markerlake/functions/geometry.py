"""Plane geometry on columns: points are structs (x, y), polygons arrays of points, implicitly closed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import mod2pi

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

PARALLEL = 1e-8


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) if not isinstance(x, Column) else F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))


def cross(o: Column, a: Column, b: Column) -> Column:
    """Twice the area of the triangle, positive where it turns left."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines ab and cd meet; null where they are parallel."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    det = ux * vy - uy * vx
    t = ((c["x"] - a["x"]) * vy - (c["y"] - a["y"]) * vx) / det
    return F.when(F.abs(det) >= PARALLEL, F.struct((a["x"] + t * ux).alias("x"), (a["y"] + t * uy).alias("y")))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments ab and cd, ends included, share a point; parallel ones do not."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    det = ux * vy - uy * vx
    t = ((c["x"] - a["x"]) * vy - (c["y"] - a["y"]) * vx) / det
    s = ((c["x"] - a["x"]) * uy - (c["y"] - a["y"]) * ux) / det
    return F.coalesce((F.abs(det) >= PARALLEL) & t.between(0, 1) & s.between(0, 1), F.lit(False))


def edges(poly: Column) -> Column:
    """Array of structs (a, b)."""
    after = F.concat(F.slice(poly, F.lit(2), F.size(poly)), F.slice(poly, F.lit(1), F.lit(1)))
    return F.zip_with(poly, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polygons_cross(p: Column, q: Column) -> Column:
    return F.exists(edges(p), lambda e: F.exists(edges(q), lambda f: segments_meet(e["a"], e["b"], f["a"], f["b"])))


def contains_point(poly: Column, q: Column) -> Column:
    """By crossings of the ray to the right."""
    hits = F.filter(edges(poly), lambda e: ((e["a"]["y"] > q["y"]) != (e["b"]["y"] > q["y"])) & (q["x"] < (e["b"]["x"] - e["a"]["x"]) * (q["y"] - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(hits) % 2 == 1


def interior_point(poly: Column) -> Column:
    """Mean of the first three corners."""
    mean = lambda k: (F.get(poly, F.lit(0))[k] + F.get(poly, F.lit(1))[k] + F.get(poly, F.lit(2))[k]) / 3
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def polygons_overlap(p: Column, q: Column) -> Column:
    return polygons_cross(p, q) | contains_point(q, interior_point(p)) | contains_point(p, interior_point(q))


def contains_polygon(p: Column, q: Column) -> Column:
    return ~polygons_cross(p, q) & contains_point(p, F.get(q, F.lit(0)))


def area2(poly: Column) -> Column:
    """Twice the signed area, positive counter-clockwise."""
    return F.aggregate(edges(poly), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def heron_area(quad: Column) -> Column:
    """Area of a quadrilateral as the two triangles at its first corner, from their sides."""
    p = lambda k: F.get(quad, F.lit(k))

    def triangle(a: Column, b: Column, c: Column) -> Column:
        u, v, w = distance(a, b), distance(b, c), distance(c, a)
        h = (u + v + w) / 2
        return F.sqrt(F.greatest(F.lit(0.0), h * (h - u) * (h - v) * (h - w)))

    return triangle(p(0), p(1), p(2)) + triangle(p(2), p(3), p(0))


def turns_convex(quad: Column, cos_critical: float) -> Column:
    """Whether a quadrilateral turns left at each corner, neither too sharply nor too little; false for equal corners."""
    after = F.concat(F.slice(quad, 2, 3), F.slice(quad, 1, 1))
    sides = F.zip_with(quad, after, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))

    def corner(u: Column, v: Column) -> Column:
        size = F.sqrt((u["x"] * u["x"] + u["y"] * u["y"]) * (v["x"] * v["x"] + v["y"] * v["y"]))
        cosine = (u["x"] * v["x"] + u["y"] * v["y"]) / F.nullif(size, F.lit(0.0))
        return F.coalesce((F.abs(cosine) <= cos_critical) & (u["x"] * v["y"] >= u["y"] * v["x"]), F.lit(False))

    return F.forall(F.zip_with(sides, F.concat(F.slice(sides, 2, 3), F.slice(sides, 1, 1)), corner), lambda ok: ok)


def make_ccw(poly: Column) -> Column:
    return F.when(area2(poly) < 0, F.reverse(poly)).otherwise(poly)


def closest_on_segment(a: Column, b: Column, q: Column) -> Column:
    ux, uy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((q["x"] - a["x"]) * ux + (q["y"] - a["y"]) * uy) / F.nullif(ux * ux + uy * uy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.struct((a["x"] + t * ux).alias("x"), (a["y"] + t * uy).alias("y"))


def closest_on_boundary(poly: Column, q: Column) -> Column:
    near = F.transform(edges(poly), lambda e: closest_on_segment(e["a"], e["b"], q))
    return F.array_min(F.transform(near, lambda p: F.struct(distance(p, q).alias("d"), p.alias("p"))))["p"]


def crossings(poly: Column, y: Column) -> Column:
    """Sorted x of the places where a horizontal line meets the boundary."""
    cut = F.filter(edges(poly), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    return F.sort_array(F.transform(cut, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))


def project(h: Column, x: Column, y: Column) -> Column:
    """A point through a homography of nine numbers, row by row."""
    at = lambda k: F.get(h, F.lit(k))
    w = at(6) * x + at(7) * y + at(8)
    return F.struct(((at(0) * x + at(1) * y + at(2)) / w).alias("x"), ((at(3) * x + at(4) * y + at(5)) / w).alias("y"))


def line(a: Column, b: Column) -> Column:
    """struct(p, u): a point and the unit direction from a to b."""
    d = distance(a, b)
    return F.struct(a.alias("p"), F.struct(((b["x"] - a["x"]) / d).alias("x"), ((b["y"] - a["y"]) / d).alias("y")).alias("u"))


def line_coordinate(ln: Column, q: Column) -> Column:
    """How far along the line the point nearest to q lies."""
    return (q["x"] - ln["p"]["x"]) * ln["u"]["x"] + (q["y"] - ln["p"]["y"]) * ln["u"]["y"]


def segment_meets_line(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the segment ab meets the line through c and d; null where it does not."""
    side = cross(c, d, a) * cross(c, d, b)
    return F.when(side <= 0, line_intersection(a, b, c, d))


def contains_point_by_winding(poly: Column, q: Column) -> Column:
    """By the angles under which the edges of a counter-clockwise polygon are seen."""
    angle = lambda p: F.atan2(q["y"] - p["y"], q["x"] - p["x"])
    turned = F.transform(edges(poly), lambda e: mod2pi(angle(e["b"]) - angle(e["a"])))
    return F.aggregate(turned, F.lit(0.0), lambda s, x: s + x) > math.pi


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Lower chain, then upper chain, of the sorted points; collinear ones are left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ordered):
        found: list[tuple[float, float]] = []
        for p in ordered:
            while len(found) > 1 and (found[-1][0] - found[-2][0]) * (p[1] - found[-2][1]) <= (found[-1][1] - found[-2][1]) * (p[0] - found[-2][0]):
                found.pop()
            found.append(p)
        return found[:-1]

    return chain(points) + chain(points[::-1])


@F.pandas_udf(POINTS)
def convex_hull(points: pd.Series) -> pd.Series:
    """The hull of an array of points, counter-clockwise from its leftmost corner; null stays null."""
    return pd.Series([None if ps is None else [{"x": x, "y": y} for x, y in _hull([(p["x"], p["y"]) for p in ps])] for ps in points])
