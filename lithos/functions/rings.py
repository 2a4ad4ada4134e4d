"""Polygons as closed rings: arrays of points (x, y) whose last point repeats the first. Simple rings, in any direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.session import parts

CELL_M = 20.0
#: Polygons whose edges one task looks at.
POLYGONS_A_TASK = 5_000


def edges(ring: Column) -> Column:
    """Array of (ax, ay, bx, by)."""
    return F.transform(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(ring, i + 1)["x"].alias("bx"), F.get(ring, i + 1)["y"].alias("by")))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def signed_area(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def centroid(ring: Column) -> Column:
    """(x, y) of the centre of area; null for a ring without area."""
    a = F.nullif(signed_area(ring), F.lit(0.0))
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    return F.struct((_sum(edges(ring), lambda e: (e["ax"] + e["bx"]) * cross(e)) / (6 * a)).alias("x"), (_sum(edges(ring), lambda e: (e["ay"] + e["by"]) * cross(e)) / (6 * a)).alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside: an odd number of edges crosses the ray above it. A side belongs to the ring that it is the
    lower or the left one of, so a point where rings meet is in one of them."""
    crossed = lambda e: ((e["ax"] > x) != (e["bx"] > x)) & (y < (e["by"] - e["ay"]) * (x - e["ax"]) / (e["bx"] - e["ax"]) + e["ay"])
    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def inset_area(ring: Column, t: Column) -> Column:
    """Area of the ring moved inwards by t with straight corners, 0 where nothing is left.

    Each side loses t times its length, each corner gives back t^2 cot(angle / 2). Exact while no side vanishes; corners
    that point inwards are mitred, not rounded.
    """
    n = F.size(ring) - 1
    turn = lambda e, f: F.atan2((e["bx"] - e["ax"]) * (f["by"] - f["ay"]) - (e["by"] - e["ay"]) * (f["bx"] - f["ax"]), (e["bx"] - e["ax"]) * (f["bx"] - f["ax"]) + (e["by"] - e["ay"]) * (f["by"] - f["ay"]))
    # cot(angle / 2) = tan(turn / 2), the turn taken counter-clockwise; sides and area are made once for all corners
    once = F.array(F.struct(edges(ring).alias("sides"), signed_area(ring).alias("a")))
    corners = F.transform(once, lambda o: _sum(F.transform(o["sides"], lambda e, i: F.tan(F.signum(o["a"]) * turn(e, F.get(o["sides"], (i + 1) % n)) / 2)), lambda v: v))
    return F.greatest(F.lit(0.0), area(ring) - t * perimeter(ring) + t * t * F.get(corners, F.lit(0)))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def within(points: DataFrame, polygons: DataFrame, point: str, polygon: str, cell: float = CELL_M) -> DataFrame:
    """point, polygon: the first polygon by its key that holds points(point, x, y), over polygons(polygon, ring).

    Both sides meet by grid cell; a polygon goes to the cells of its bounding box.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = polygons.select(polygon, "ring", F.explode(_cells(F.array_min(xs), F.array_max(xs), cell)).alias("gx"), _cells(F.array_min(ys), F.array_max(ys), cell).alias("gys"))
    boxes = boxes.select(polygon, "ring", "gx", F.explode("gys").alias("gy"))
    at = points.select(point, "x", "y", F.floor(F.col("x") / cell).cast("long").alias("gx"), F.floor(F.col("y") / cell).cast("long").alias("gy"))
    return at.join(boxes, ["gx", "gy"]).where(contains(F.col("ring"), F.col("x"), F.col("y"))).groupBy(point).agg(F.min(polygon).alias(polygon))


def touching(polygons: DataFrame, key: str, cell: float = CELL_M, grain: float = 1e-6) -> DataFrame:
    """key, touching: length of each outline that lies on other outlines, over polygons(key, ring).

    Edges meet only edges of the same straight line, by its direction and distance from the origin, and of the same
    stretch of it; each pair shares the overlap within the stretch, so the stretches add up to the exact length.
    """
    e = polygons.select(key, F.explode(edges(F.col("ring"))).alias("e")).select(key, "e.*")
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    e = e.withColumn("length", length).where("length > 0").withColumns({"ux": (F.col("bx") - F.col("ax")) / F.col("length"), "uy": (F.col("by") - F.col("ay")) / F.col("length")})
    flip = F.when((F.round("ux", 9) < 0) | ((F.round("ux", 9) == 0) & (F.col("uy") < 0)), -1.0).otherwise(1.0)
    e = e.withColumns({"ux": F.col("ux") * flip, "uy": F.col("uy") * flip})
    along = lambda x, y: F.col(x) * F.col("ux") + F.col(y) * F.col("uy")
    e = e.withColumns({"t0": F.least(along("ax", "ay"), along("bx", "by")), "t1": F.greatest(along("ax", "ay"), along("bx", "by"))})
    grid = lambda c: F.round(c / grain).cast("long")
    e = e.select(key, grid(F.atan2("uy", "ux")).alias("direction"), grid(F.col("ay") * F.col("ux") - F.col("ax") * F.col("uy")).alias("distance"), "t0", "t1", F.explode(_cells(F.col("t0"), F.col("t1"), cell)).alias("stretch"))
    e = e.withColumns({"t0": F.greatest("t0", F.col("stretch") * cell), "t1": F.least("t1", (F.col("stretch") + 1) * cell)})
    o = e.select(F.col(key).alias("o_key"), "direction", "distance", "stretch", F.col("t0").alias("o0"), F.col("t1").alias("o1"))
    n, on = parts(polygons, POLYGONS_A_TASK), ["direction", "distance", "stretch"]
    met = e.repartition(n, *on).join(o.repartition(n, *on).hint("merge"), on).where(F.col(key) != F.col("o_key"))
    shared = F.least("t1", "o1") - F.greatest("t0", "o0")
    return met.select(key, shared.alias("shared")).where("shared > 0").groupBy(key).agg(F.sum("shared").alias("touching"))
