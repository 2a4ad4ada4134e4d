"""Ordered one-dimensional operators: islands, linkage, runs, profiles; and the point-cloud reductions built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], at: str, gap: float, tie: list[str]) -> DataFrame:
    """rows with island: numbered anew wherever the step to the row before exceeds gap."""
    order = W.partitionBy(*by).orderBy(at, *tie)
    head = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("_h", head).withColumn("island", F.sum("_h").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_h")


def palette(rows: DataFrame, by: list[str], at: str, gap: float, least: float) -> DataFrame:
    """Median of each island of values, two decimals and not below least."""
    distinct = islands(rows, by, at, gap, [])
    return distinct.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.round(F.median(at), 2), F.lit(least)).alias("value"))


def voxels(points: DataFrame, size: float) -> DataFrame:
    """Mean point of every occupied voxel; the only shuffle carries partial sums."""
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    return points.groupBy("scan_id", cell("x").alias("ix"), cell("y").alias("iy"), cell("z").alias("iz")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def occupancy(points: DataFrame, cell: float, z_bin: float) -> DataFrame:
    """Distinct occupied (ix, iy) cells per height bin."""
    at = points.select("scan_id", F.floor(F.col("z") / z_bin).cast("long").alias("iz"), F.floor(F.col("x") / cell).cast("long").alias("ix"), F.floor(F.col("y") / cell).cast("long").alias("iy"))
    return at.distinct().groupBy("scan_id", "iz").agg(F.count(F.lit(1)).alias("cells"))


def peaks(profile: DataFrame, share: float) -> DataFrame:
    """Bins of a profile(scan_id, iz, cells) that no neighbour exceeds and that reach a share of the largest."""
    order = W.partitionBy("scan_id").orderBy("iz")
    near = lambda f: F.when(F.abs(f("iz").over(order) - F.col("iz")) == 1, f("cells").over(order)).otherwise(0)
    top = F.max("cells").over(W.partitionBy("scan_id"))
    p = profile.withColumns({"before": F.coalesce(near(F.lag), F.lit(0)), "after": F.coalesce(near(F.lead), F.lit(0)), "top": top})
    return p.where((F.col("cells") >= F.col("before")) & (F.col("cells") > F.col("after")) & (F.col("cells") >= share * F.col("top"))).select("scan_id", "iz", "cells")


def circular_mean(angle: str, weight: str) -> Column:
    """Length-weighted mean direction in degrees, modulo 180."""
    a = F.radians(F.col(angle) * 2)
    mean = F.degrees(F.atan2(F.sum(F.sin(a) * F.col(weight)), F.sum(F.cos(a) * F.col(weight)))) / 2
    return F.pmod(mean, F.lit(180.0))


def shoelace(ring: Column) -> Column:
    """Area of a closed or open ring of (x, y)."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, F.pmod(i + 1, n))["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2
