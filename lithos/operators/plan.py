"""Quantities of an imported plan: walls, areas, placemarks, scale, and what is sent for each storey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions import rings

POINT_MM = 25.4 / 72


def scale_mm(denominator: Column) -> Column:
    """Millimetres per plan unit at a scale of 1 : denominator; null unless it is positive."""
    return F.when(denominator > 0, POINT_MM * denominator)


def two_point_mm(real_mm: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Millimetres per plan unit from two points of known distance; null unless both lengths are positive."""
    drawn = F.hypot(bx - ax, by - ay)
    return F.when((real_mm > 0) & (drawn > 0), real_mm / drawn)


def run_length(area: Column, thickness: Column) -> Column:
    """Length of a wall drawn as an area; 0 without a thickness."""
    return F.when(thickness > 0, area / thickness).otherwise(0.0)


def despeckled(segments: DataFrame, mm_per_unit: Column, least_mm2: float = 1500.0) -> DataFrame:
    """segments(area, ...) without those whose real area is below the threshold."""
    return segments.where(F.coalesce(F.col("area") * mm_per_unit * mm_per_unit >= least_mm2, F.lit(True)))


def merged(segments: DataFrame, merges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, groups) after merges(group_id, target): members move to the target, groups without members go."""
    moved = segments.join(merges, "group_id", "left").withColumn("group_id", F.coalesce("target", "group_id")).drop("target")
    return moved, groups.join(moved.select("group_id").distinct(), "group_id", "left_semi")


def wall_rows(segments: DataFrame, groups: DataFrame, mm_per_unit: str = "mm_per_unit") -> DataFrame:
    """plan_id, group_id, length_m of groups(plan_id, group_id, n_layers, mm_per_unit) that have layers and live members;
    segments(plan_id, group_id, length). A plan without a scale has length 0."""
    lengths = segments.groupBy("plan_id", "group_id").agg(F.sum("length").alias("units"))
    return groups.where("n_layers > 0").join(lengths, ["plan_id", "group_id"]).select("plan_id", "group_id", F.coalesce(F.col("units") * F.col(mm_per_unit) / 1000, F.lit(0.0)).alias("length_m"))


def floor_areas(polygons: DataFrame, segments: DataFrame, cell: float = 20.0) -> DataFrame:
    """plan_id, polygon_id, area_m2: the given net area, else the outline less the walls inside it, scaled; null without a
    scale.

    polygons(plan_id, polygon_id, ring, net_area_m2, mm_per_unit), segments(plan_id, x, y, area): a segment counts where its
    centre lies, and meets only polygons of its plan and grid cell.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell).cast("long"), F.floor(F.array_max(v) / cell).cast("long"))
    boxes = polygons.select("plan_id", "polygon_id", "ring", F.explode(span(xs)).alias("gx"), span(ys).alias("gys")).select("plan_id", "polygon_id", "ring", "gx", F.explode("gys").alias("gy"))
    at = segments.select("plan_id", "x", "y", "area", F.floor(F.col("x") / cell).cast("long").alias("gx"), F.floor(F.col("y") / cell).cast("long").alias("gy"))
    inside = at.join(boxes, ["plan_id", "gx", "gy"]).where(rings.contains(F.col("ring"), F.col("x"), F.col("y")))
    walls = inside.groupBy("plan_id", "polygon_id").agg(F.sum("area").alias("walls"))
    per_m = F.col("mm_per_unit") / 1000
    net = F.greatest(F.lit(0.0), rings.area(F.col("ring")) - F.coalesce("walls", F.lit(0.0))) * per_m * per_m
    return polygons.join(walls, ["plan_id", "polygon_id"], "left").select("plan_id", "polygon_id", F.coalesce("net_area_m2", net).alias("area_m2"))


def folded(placemarks: DataFrame, *also: str) -> DataFrame:
    """Equal placemarks as one row with their count; nulls are equal. The export also keeps apart what also names."""
    key = ["type", "name", "length", "width", "height", *also]
    return placemarks.groupBy(*key).agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"))


def payload(part_type: Column, length: Column, area: Column, core: Column, fire_wall: Column) -> Column:
    """A part as it is sent: lengths to 3 decimals, flags only where they are true; a fire wall has a neighbour."""
    r3 = lambda c: F.floor(c * 1000 + 0.5) / 1000
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(True))
    wall = part_type.isin("AW", "IW", "BW")
    return F.struct(F.when(wall, "wall").otherwise("slab").alias("type"), F.when(wall, r3(length)).alias("length"), F.when(~wall, r3(area)).alias("area"), flag(core).alias("kerndicke"), flag(fire_wall).alias("nachbarkontakt"))


def totals(parts: DataFrame) -> DataFrame:
    """Number, length and area of the parts of each plan and type."""
    return parts.groupBy("plan_id", "part_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("length_m", F.lit(0.0))).alias("length_m"), F.sum(F.coalesce("area_m2", F.lit(0.0))).alias("area_m2"))
