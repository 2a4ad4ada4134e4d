"""Storeys and the bands of floors, ceilings, walls and roofs in point clouds.

Profiles over the height are aggregated in Spark; a profile has a row per bin of a scan's height, so finding its peaks is
a small function of one scan's bins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.profiles import peaks, smoothed


def area_profile(points: DataFrame, cell: float, z_bin: float) -> DataFrame:
    """scan_id, z_min, z_max, iz, cells: occupied cells of the horizontal points per bin of the height.

    points(scan_id, x, y, z, horizontal); bins and cells begin at the smallest coordinates of all points of the scan.
    """
    box = points.groupBy("scan_id").agg(*[F.min(c).alias(f"{c}_min") for c in "xyz"], F.max("z").alias("z_max"), F.count_if("horizontal").alias("n_horizontal"))
    flat = points.where("horizontal").join(box, "scan_id")
    at = lambda c, size: F.floor((F.col(c) - F.col(f"{c}_min")) / size).cast("long").alias(f"i{c}")
    cells = flat.select("scan_id", at("x", cell), at("y", cell), at("z", z_bin)).distinct().groupBy("scan_id", "iz").agg(F.count(F.lit(1)).alias("cells"))
    return box.join(cells, "scan_id", "left").select("scan_id", "z_min", "z_max", "n_horizontal", "iz", "cells")


def storey_levels(z_min: float, z_max: float, area: np.ndarray, z_bin: float, cell: float, spacing: float, least_area: float, share: float, margin: float, room: float) -> list[tuple]:
    """(z_floor, z_ceiling, low, high) of each storey of an area profile; empty where no floor stands out."""
    centres = z_min + (np.arange(len(area)) + 0.5) * z_bin
    least = max(1, round(least_area / (cell * cell)))
    smooth = smoothed(area, 1.0)
    floors = peaks(smooth, max(float(least), share * float(smooth.max())), max(1, round(spacing / z_bin)), 0.5 * least)
    surfaces = centres[peaks(smooth, float(least), max(1, round(0.4 / z_bin)))]
    z, out = centres[np.sort(floors)], []
    for i, floor in enumerate(z):
        low = z_min if i == 0 else floor - margin
        if i == len(z) - 1:
            ceiling, high = None, z_max + 1e-6
        else:
            between = surfaces[(surfaces > floor + room) & (surfaces < z[i + 1] - margin)]
            ceiling, high = (float(between.max()) if len(between) else None), z[i + 1] - margin
        out.append((float(floor), ceiling, float(low), float(max(high, low + 0.1))))
    return out


def storeys(points: DataFrame, cell: float = 0.20, z_bin: float = 0.05, spacing: float = 2.8, least_area: float = 5.0, share: float = 0.15, margin: float = 0.15, room: float = 1.5) -> DataFrame:
    """scan_id, storey (from 0), z_floor, z_ceiling, low, high.

    points(scan_id, x, y, z, horizontal). A scan with fewer than 50 horizontal points or without a floor is one storey
    without levels; one lower than half a metre has none.
    """

    def body(t: pd.DataFrame) -> pd.DataFrame:
        z_min, z_max = float(t["z_min"].iloc[0]), float(t["z_max"].iloc[0])
        if z_max - z_min < 0.5:
            return pd.DataFrame(columns=["scan_id", "storey", "z_floor", "z_ceiling", "low", "high"])
        area = np.zeros(max(16, math.ceil((z_max - z_min) / z_bin)))
        seen = t[(t["iz"] >= 0) & (t["iz"] < len(area))]
        area[seen["iz"].astype(int)] = seen["cells"]
        found = storey_levels(z_min, z_max, area, z_bin, cell, spacing, least_area, share, margin, room) if t["n_horizontal"].iloc[0] >= 50 else []
        rows = [(t["scan_id"].iloc[0], k, *x) for k, x in enumerate(found or [(None, None, z_min, z_max + 1e-6)])]
        return pd.DataFrame(rows, columns=["scan_id", "storey", "z_floor", "z_ceiling", "low", "high"])

    schema = "scan_id long, storey int, z_floor double, z_ceiling double, low double, high double"
    return area_profile(points, cell, z_bin).groupBy("scan_id").applyInPandas(body, schema)


def with_storey(points: DataFrame, levels: DataFrame) -> DataFrame:
    """points with storey; null below the first. A scan's storeys are one small row, the last includes its upper end."""
    bounds = levels.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("storey", "low", "high"))).alias("_levels"))
    last = F.element_at("_levels", -1)["storey"]
    inside = F.filter("_levels", lambda s: (F.col("z") >= s["low"]) & ((F.col("z") < s["high"]) | ((s["storey"] == last) & (F.col("z") <= s["high"]))))
    return points.join(bounds, "scan_id", "left").withColumn("storey", F.get(inside, F.lit(0))["storey"]).drop("_levels")


def floor_and_ceiling(rows: DataFrame, steep: float = 0.8, z_bin: float = 0.05) -> DataFrame:
    """scan_id, z_floor, z_ceiling, z_ceiling_min of surfaces() rows, from peaks of the heights of horizontal points.

    The floor is the lowest peak below the middle of the height, the ceilings are the highest and lowest above it; what is
    not found, and all where fewer than ten points are horizontal, is the end of the height.
    """
    flat = F.abs("nz") > steep
    box = rows.groupBy("scan_id").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.min(F.when(flat, F.col("z"))).alias("lo"), F.max(F.when(flat, F.col("z"))).alias("hi"), F.count_if(flat).alias("n_flat"))
    box = box.withColumn("bins", F.greatest(F.lit(64), F.ceil((F.col("hi") - F.col("lo")) / z_bin)).cast("long"))
    bin_ = F.least(F.col("bins") - 1, F.floor(F.try_divide((F.col("z") - F.col("lo")) * F.col("bins"), F.col("hi") - F.col("lo"))))
    hist = rows.where(flat).join(box, "scan_id").groupBy("scan_id", F.coalesce(bin_, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def body(t: pd.DataFrame) -> pd.DataFrame:
        z_min, z_max, lo, hi = (float(t[c].iloc[0]) for c in ("z_min", "z_max", "lo", "hi"))
        floor, ceiling, lowest = z_min, z_max, z_max
        if t["n_flat"].iloc[0] >= 10:
            count = np.zeros(int(t["bins"].iloc[0]))
            count[t["bin"].astype(int)] = t["n"]
            at = lo + (peaks(count, None, 3, 0.1 * count.max()) + 0.5) * (hi - lo) / len(count)
            below, above = at[at < (z_min + z_max) / 2], at[at >= (z_min + z_max) / 2]
            floor = float(below.min()) if len(below) else floor
            ceiling, lowest = (float(above.max()), float(above.min())) if len(above) else (ceiling, lowest)
        return pd.DataFrame([(t["scan_id"].iloc[0], floor, ceiling, lowest)], columns=["scan_id", "z_floor", "z_ceiling", "z_ceiling_min"])

    return box.join(hist, "scan_id", "left").groupBy("scan_id").applyInPandas(body, "scan_id long, z_floor double, z_ceiling double, z_ceiling_min double")


def masks(rows: DataFrame, levels: DataFrame, steep: float = 0.8, slab: float = 0.3, wall_cos: float = 0.2, band: float = 0.8, roof: tuple[float, float] = (0.2, 0.985)) -> DataFrame:
    """rows with floor_band, ceil_band, wall and roof, and const_height, of surfaces() rows and floor_and_ceiling()."""
    up, z = F.abs("nz"), F.col("z")
    near = lambda level: (up > steep) & (F.abs(z - F.col(level)) < slab)
    middle, half = (F.col("z_floor") + F.col("z_ceiling")) / 2, band * (F.col("z_ceiling") - F.col("z_floor")) / 2
    wall: Column = (F.col("planarity") > 0.7) & (up < wall_cos) & ~near("z_floor") & ~near("z_ceiling") & z.between(middle - half, middle + half)
    roof_ = (F.col("planarity") > 0.3) & (up > roof[0]) & (up < roof[1]) & ~near("z_floor")
    out = rows.join(levels, "scan_id").withColumns({"floor_band": near("z_floor"), "ceil_band": near("z_ceiling"), "wall": wall, "roof": roof_})
    return out.withColumn("const_height", F.abs(F.col("z_ceiling_min") - F.col("z_floor")) - slab).drop("z_floor", "z_ceiling", "z_ceiling_min")
