"""Queries over point clouds: outliers, surroundings, planar segments, storeys and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import clouds, storeys
from lithos.operators import islands as il
from lithos.plans.views import view, with_views

VOXEL = 0.5
#: No multiple of the coordinates' steps, so that no distance is on the edge.
RADIUS = 0.7654321
#: Covariances are given in this unit, in which no value of the coordinates' steps lies on the edge of rounding.
UNIT = 0.987654321


def _points(spark, d):
    v = il.voxels(view(spark, d, "points"), VOXEL)
    return v.select(F.col("scan_id").cast("long").alias("scan_id"), ((F.col("ix") * 1000 + F.col("iy")) * 1000 + F.col("iz")).alias("pt"), "x", "y", "z")


def _surfaces(spark, d):
    return clouds.surfaces(_points(spark, d), RADIUS, 60)


def q_outliers(spark, d):
    rows = clouds.outliers(_points(spark, d), 12, 2.0, 0.75)
    return rows.select("scan_id", "pt", F.round("mean_distance", 6).alias("mean_distance"), "inlier")


def q_moments(spark, d):
    rows = clouds.moments(_points(spark, d), RADIUS, 60).withColumns(clouds.covariance())
    return rows.select("scan_id", "pt", "n", *[(F.round(F.col(c) * UNIT, 7) + 0.0).alias(c) for c in clouds.covariance()])


def q_segments(spark, d):
    rows = clouds.planar_segments(_surfaces(spark, d), 16, RADIUS, 25.0, 0.12, 0.1, 5)
    return rows.groupBy("scan_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("pt").alias("first"))


def q_storeys(spark, d):
    rows = _surfaces(spark, d).withColumn("horizontal", F.abs("nz") > 0.85)
    levels = storeys.storeys(rows, VOXEL, VOXEL, 2.8, 5.0)
    return storeys.with_storey(rows, levels).groupBy("scan_id", "storey").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("z"), 6).alias("lowest"))


def q_masks(spark, d):
    rows = _surfaces(spark, d)
    out = storeys.masks(rows, storeys.floor_and_ceiling(rows))
    return out.select("scan_id", "pt", "floor_band", "ceil_band", "wall", "roof", F.round("const_height", 6).alias("const_height"))


QUERIES = {"statistical_outliers": q_outliers, "neighbour_moments": q_moments, "planar_segments": q_segments, "cloud_storeys": q_storeys, "surface_masks": q_masks}

_P = f"""
WITH v AS (SELECT scan_id, floor(x / {VOXEL})::BIGINT AS ix, floor(y / {VOXEL})::BIGINT AS iy, floor(z / {VOXEL})::BIGINT AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY 1, 2, 3, 4),
p AS (SELECT scan_id::BIGINT AS scan_id, (ix * 1000 + iy) * 1000 + iz AS pt, x, y, z FROM v)"""
_D2 = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)"


def _cov(i: str, j: str) -> str:
    mean = lambda c: f"avg(b.{c} - a.{c})"
    value = f"avg((b.{i} - a.{i}) * (b.{j} - a.{j})) - {mean(i)} * {mean(j)}"
    return f"round((CASE WHEN count(*) >= 3 THEN {value} ELSE {1.0 if i == j else 0.0} END) * {UNIT}, 7) + 0.0 AS c{i}{j}"


_V = {
    "statistical_outliers": f"""{_P},
m AS (SELECT a.scan_id, a.pt, list_avg(min(sqrt({_D2}), 12)) AS d FROM p a JOIN p b USING (scan_id) GROUP BY 1, 2),
s AS (SELECT scan_id, avg(d) + 2 * stddev_samp(d) AS most FROM m GROUP BY 1)
SELECT scan_id, pt, round(d, 6) AS mean_distance, coalesce(d > 0 AND d < most, false) AS inlier FROM m JOIN s USING (scan_id)""",
    "neighbour_moments": f"""{_P}
SELECT a.scan_id, a.pt, count(*) AS n, {", ".join(_cov(*c) for c in ("xx", "xy", "xz", "yy", "yz", "zz"))}
FROM p a JOIN p b USING (scan_id) WHERE {_D2} <= {RADIUS} * {RADIUS} GROUP BY 1, 2""",
}
ORACLES = {k: with_views(v, "points") for k, v in _V.items()}
