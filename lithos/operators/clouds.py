"""Point clouds: exact nearest neighbours, outliers, surface normals, planar segments and the spread of their labels.

Points are scan_id, pt (unique within a scan), x, y, z. They are dealt by tiles of space; a tile also gets the points
within reach outside it (its halo), so that every neighbourhood is whole within one task. After voxels() a tile's points
are bounded by its volume, however large the scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.operators.components import components
from lithos.session import cut

#: Width of a tile in reaches; the share of points that are copied falls with it.
TILE = 8
#: Candidate pairs that a task holds at once.
PAIRS = 2_000_000
AXES = ("x", "y", "z")


def pairs_within(xyz: np.ndarray, queries: np.ndarray, reach: float, k: int | None = None):
    """Blocks of (query, point, squared distance), sorted by these but distance before point; at most the k nearest.

    queries are rows of xyz. A point is its own neighbour. Points are sorted by cells of width reach, so a query's
    candidates are nine runs of three cells.
    """
    low = xyz.min(0) - reach
    cells = np.floor((xyz - low) / reach).astype(np.int64)
    ny, nz = cells[:, 1].max() + 2, cells[:, 2].max() + 2
    key = (cells[:, 0] * ny + cells[:, 1]) * nz + cells[:, 2]
    order = np.argsort(key, kind="stable")
    runs = key[order]
    around = np.array([(i * ny + j) * nz for i in (-1, 0, 1) for j in (-1, 0, 1)])
    base = key[queries][:, None] + around
    first, last = np.searchsorted(runs, base - 1), np.searchsorted(runs, base + 1, "right")
    upto = np.concatenate(([0], np.cumsum((last - first).sum(1))))
    lo = 0
    while lo < len(queries):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        size = (last - first)[lo:hi].ravel()
        ends = np.cumsum(size)
        p = order[np.arange(ends[-1]) + np.repeat(first[lo:hi].ravel() - (ends - size), size)]
        q = np.repeat(np.arange(lo, hi), (last - first)[lo:hi].sum(1))
        d = xyz[p] - xyz[queries[q]]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        near = np.flatnonzero(d2 <= reach * reach)
        near = near[np.lexsort((p[near], d2[near], q[near]))]
        q, p, d2 = q[near], p[near], d2[near]
        if k is not None and len(q):
            head = np.concatenate(([True], q[1:] != q[:-1]))
            rank = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
            q, p, d2 = q[rank < k], p[rank < k], d2[rank < k]
        yield q, p, d2
        lo = hi


def tiled(points: DataFrame, size: float, halo: float) -> DataFrame:
    """points once for each tile (tx, ty, tz) that they are in or within halo of; own tells which is theirs."""
    out, own = points, F.lit(True)
    for c in AXES:
        at = lambda v: F.floor(v / size).cast("long")
        out = out.withColumn(f"t{c}", F.explode(F.sequence(at(F.col(c) - 1.000001 * halo), at(F.col(c) + 1.000001 * halo))))
        own &= F.col(f"t{c}") == at(F.col(c))
    return out.withColumn("own", own)


def by_tile(points: DataFrame, size: float, halo: float, body, schema: str, asked: DataFrame | None = None) -> DataFrame:
    """body(tile's points in order of pt, places of the queries) for every tile; all points are queries, or those asked for."""
    rows = tiled(points, size, halo)
    if asked is None:
        rows = rows.withColumn("asked", F.col("own"))
    else:
        marks = asked.select("scan_id", "pt", F.lit(True).alias("mark"))
        rows = rows.join(marks, ["scan_id", "pt"], "left").withColumn("asked", F.col("own") & F.coalesce("mark", F.lit(False))).drop("mark")
        wanted = rows.where("asked").select("scan_id", "tx", "ty", "tz").distinct()
        rows = rows.join(wanted, ["scan_id", "tx", "ty", "tz"], "left_semi")

    def tile(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pt", kind="stable", ignore_index=True)
        queries = np.flatnonzero(t["asked"].to_numpy())
        return body(t, queries) if len(queries) else pd.DataFrame()

    return rows.groupBy("scan_id", "tx", "ty", "tz").applyInPandas(lambda t: tile(t).reindex(columns=names(schema)).astype(kinds(schema)), schema)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def kinds(schema: str) -> dict[str, str]:
    return {n: {"long": "int64", "double": "float64", "boolean": "bool"}[k] for n, k in (x.split() for x in schema.split(", "))}


def mean_distances(points: DataFrame, k: int, reach: float) -> DataFrame:
    """scan_id, pt, mean_distance: over the k nearest points, the point itself among them (all points of smaller scans).

    A point is done when k points lie within reach; for the rest reach grows fourfold, until it spans the largest scan.
    Only tiles with such points are looked at again, so isolated points cost their own surroundings.
    """
    schema = "scan_id long, pt long, mean_distance double, n long"

    def body(t: pd.DataFrame, queries: np.ndarray, reach: float) -> pd.DataFrame:
        total, n = np.zeros(len(queries)), np.zeros(len(queries), np.int64)
        for q, _, d2 in pairs_within(t[list(AXES)].to_numpy(), queries, reach, k):
            total += np.bincount(q, np.sqrt(d2), len(queries))
            n += np.bincount(q, minlength=len(queries))
        return pd.DataFrame({"scan_id": t["scan_id"].to_numpy()[queries], "pt": t["pt"].to_numpy()[queries], "mean_distance": total / n, "n": n})

    spread = points.groupBy("scan_id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in AXES]).agg(*[F.max(c) for c in AXES]).first()
    largest = float(np.sqrt(sum((v or 0.0) ** 2 for v in spread)))
    done, asked, tile = None, None, TILE
    while True:
        found = cut(by_tile(points, tile * reach, reach, lambda t, q, r=reach: body(t, q, r), schema, asked))
        last = reach >= largest
        sure = (found if last else found.where(F.col("n") == k)).select("scan_id", "pt", "mean_distance")
        done = sure if done is None else done.union(sure)
        asked = found.where(F.col("n") < k)
        if last or asked.isEmpty():
            return done
        reach, tile = 4 * reach, 1


def outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, reach: float = 0.25) -> DataFrame:
    """scan_id, pt, mean_distance, inlier: whether the mean distance is positive and below the scan's mean of them plus ratio
    sample deviations."""
    rows = mean_distances(points, k, reach)
    limits = rows.groupBy("scan_id").agg((F.avg("mean_distance") + ratio * F.stddev_samp("mean_distance")).alias("limit"))
    inlier = (F.col("mean_distance") > 0) & (F.col("mean_distance") < F.col("limit"))
    return rows.join(limits, "scan_id").select("scan_id", "pt", "mean_distance", F.coalesce(inlier, F.lit(False)).alias("inlier"))


def cleaned(points: DataFrame, k: int = 20, ratio: float = 2.0, reach: float = 0.25) -> DataFrame:
    """points without outliers, moved so that each scan starts at zero on every axis."""
    kept = points.join(outliers(points, k, ratio, reach).where("inlier"), ["scan_id", "pt"], "left_semi")
    origin = kept.groupBy("scan_id").agg(*[F.min(c).alias(f"_{c}") for c in AXES])
    return kept.join(origin, "scan_id").withColumns({c: F.col(c) - F.col(f"_{c}") for c in AXES}).drop(*[f"_{c}" for c in AXES])


MOMENTS = ("sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


def moments(points: DataFrame, radius: float, k: int) -> DataFrame:
    """scan_id, pt, x, y, z, n and sums of the first and second powers of the differences to the k nearest within radius."""
    schema = "scan_id long, pt long, x double, y double, z double, n long, " + ", ".join(f"{m} double" for m in MOMENTS)

    def body(t: pd.DataFrame, queries: np.ndarray) -> pd.DataFrame:
        xyz = t[list(AXES)].to_numpy()
        out = {m: np.zeros(len(queries)) for m in MOMENTS} | {"n": np.zeros(len(queries), np.int64)}
        for q, p, _ in pairs_within(xyz, queries, radius, k):
            d = dict(zip(AXES, (xyz[p] - xyz[queries[q]]).T, strict=True))
            out["n"] += np.bincount(q, minlength=len(queries))
            for m in MOMENTS:
                out[m] += np.bincount(q, np.prod([d[c] for c in m[1:]], axis=0), len(queries))
        return pd.DataFrame({c: t[c].to_numpy()[queries] for c in ("scan_id", "pt", *AXES)} | out)

    return by_tile(points.select("scan_id", "pt", *AXES), TILE * radius, radius, body, schema)


def covariance() -> dict[str, Column]:
    """cxx to czz of the moments; fewer than three points have the unit matrix."""
    out = {}
    for m in MOMENTS[3:]:
        i, j = m[1:]
        value = F.col(m) / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n")
        out[f"c{i}{j}"] = F.when(F.col("n") >= 3, value).otherwise(1.0 if i == j else 0.0)
    return out


def eigenvalues(rows: DataFrame) -> DataFrame:
    """rows(cxx, ..., czz) with l0 <= l1 <= l2, by the closed form for symmetric 3x3 matrices."""
    c = F.col
    off = c("cxy") * c("cxy") + c("cxz") * c("cxz") + c("cyz") * c("cyz")
    rows = rows.withColumn("_q", (c("cxx") + c("cyy") + c("czz")) / 3)
    rows = rows.withColumn("_p", F.sqrt((sum((c(d) - c("_q")) * (c(d) - c("_q")) for d in ("cxx", "cyy", "czz")) + 2 * off) / 6))
    a, b, d = (c(x) - c("_q") for x in ("cxx", "cyy", "czz"))
    det = a * (b * d - c("cyz") * c("cyz")) - c("cxy") * (c("cxy") * d - c("cyz") * c("cxz")) + c("cxz") * (c("cxy") * c("cyz") - b * c("cxz"))
    half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2 * c("_p") * c("_p") * c("_p"))))
    rows = rows.withColumn("_phi", F.acos(F.coalesce(half, F.lit(1.0))) / 3)
    rows = rows.withColumns({"l2": c("_q") + 2 * c("_p") * F.cos("_phi"), "l0": c("_q") + 2 * c("_p") * F.cos(c("_phi") + 2 * F.pi() / 3)})
    rows = rows.withColumn("l0", F.greatest(c("l0"), F.lit(0.0)))
    return rows.withColumn("l1", F.greatest(c("l0"), 3 * c("_q") - c("l0") - c("l2"))).drop("_q", "_p", "_phi")


def normals(rows: DataFrame) -> DataFrame:
    """rows with nx, ny, nz: the direction of l0, the longest cross product of two rows of the matrix less l0; upwards where
    no direction stands out."""
    c = F.col
    m = [[c("cxx") - c("l0"), c("cxy"), c("cxz")], [c("cxy"), c("cyy") - c("l0"), c("cyz")], [c("cxz"), c("cyz"), c("czz") - c("l0")]]
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    made = [cross(m[i], m[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    sized = F.array(*[F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("d"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z")) for v in made])
    rows = rows.withColumn("_n", F.array_max(sized))
    some = c("_n.d") > 1e-24 * F.pow(c("l2"), 4)
    unit = {f"n{a}": F.when(some & (c("n") >= 3), c(f"_n.{a}") / F.sqrt("_n.d")).otherwise(1.0 if a == "z" else 0.0) for a in AXES}
    return rows.withColumns(unit).drop("_n")


def surfaces(points: DataFrame, radius: float = 0.2, k: int = 40) -> DataFrame:
    """scan_id, pt, x, y, z with the normal, planarity (l1 - l0) / l2 and curvature l0 / (l0 + l1 + l2) of the surroundings.

    Written once, since all that follows reads it several times, and so that no filter is pushed into the long formulas.
    """
    rows = normals(eigenvalues(moments(points, radius, k).withColumns(covariance())))
    planarity, curvature = (F.col("l1") - F.col("l0")) / (F.col("l2") + 1e-9), F.col("l0") / (F.col("l0") + F.col("l1") + F.col("l2") + 1e-12)
    return cut(rows.select("scan_id", "pt", *AXES, "nx", "ny", "nz", planarity.alias("planarity"), curvature.alias("curvature")))


def grown_edges(rows: DataFrame, radius: float, k: int, angle: float, plane: float) -> DataFrame:
    """scan_id, a, b: neighbours that are both flat, of like normals, and in one plane."""
    least = float(np.cos(np.radians(angle)))

    def body(t: pd.DataFrame, queries: np.ndarray) -> pd.DataFrame:
        xyz, n, flat, pt = t[list(AXES)].to_numpy(), t[["nx", "ny", "nz"]].to_numpy(), t["flat"].to_numpy(), t["pt"].to_numpy()
        out = []
        for q, p, _ in pairs_within(xyz, queries, radius, k):
            u = queries[q]
            ok = (u != p) & flat[u] & flat[p] & (np.abs((n[u] * n[p]).sum(1)) >= least) & (np.abs(((xyz[u] - xyz[p]) * n[u]).sum(1)) <= plane)
            out.append(pd.DataFrame({"a": pt[u[ok]], "b": pt[p[ok]]}))
        return pd.concat(out).assign(scan_id=t["scan_id"].iloc[0])

    return by_tile(rows, TILE * radius, radius, body, "scan_id long, a long, b long")


def spread(rows: DataFrame, labels: DataFrame, radius: float, angle: float, k: int = 8, rounds: int = 4) -> DataFrame:
    """labels(scan_id, pt, label) grown onto further rows, round by round.

    A point without a label takes that of the nearest labelled point within radius whose normal agrees, if that is among
    the k nearest labelled ones. The graph of such points is written once; a round joins the labels of the last one.
    """
    least = float(np.cos(np.radians(angle)))
    open_ = rows.join(labels, ["scan_id", "pt"], "left_anti").select("scan_id", "pt")

    def body(t: pd.DataFrame, queries: np.ndarray) -> pd.DataFrame:
        n, pt, out = t[["nx", "ny", "nz"]].to_numpy(), t["pt"].to_numpy(), []
        for q, p, d2 in pairs_within(t[list(AXES)].to_numpy(), queries, radius):
            u = queries[q]
            out.append(pd.DataFrame({"pt": pt[u], "o_pt": pt[p], "d2": d2, "agrees": np.abs((n[u] * n[p]).sum(1)) >= least})[u != p])
        return pd.concat(out).assign(scan_id=t["scan_id"].iloc[0])

    graph = cut(by_tile(rows, TILE * radius, radius, body, "scan_id long, pt long, o_pt long, d2 double, agrees boolean", open_))
    nearest = W.partitionBy("scan_id", "pt").orderBy("d2", "o_pt")
    for _ in range(rounds):
        known = labels.select("scan_id", F.col("pt").alias("o_pt"), "label")
        votes = graph.join(labels.select("scan_id", "pt"), ["scan_id", "pt"], "left_anti").join(known, ["scan_id", "o_pt"])
        votes = votes.withColumn("rank", F.row_number().over(nearest)).where((F.col("rank") <= k) & F.col("agrees"))
        new = cut(votes.groupBy("scan_id", "pt").agg(F.min_by("label", "rank").alias("label")))
        if new.isEmpty():
            break
        labels = labels.unionByName(new)
    return labels


def planar_segments(rows: DataFrame, k: int = 16, radius: float = 0.30, angle: float = 25.0, plane: float = 0.12, curvature: float = 0.035, least: int = 20) -> DataFrame:
    """scan_id, pt, label: planar segments of surfaces() rows, grown over neighbours of low curvature.

    Corners have a high curvature and cut the graph, so walls of any angle are found and two walls at a corner stay apart.
    A segment's label is its smallest pt; components below least points have none; points left out are then added by
    spread() with 20 degrees more. Points without a label do not appear.
    """
    bent = eigenvalues(moments(rows, radius, k).withColumns(covariance()))
    flat = bent.select("scan_id", "pt", (F.col("l0") / (F.col("l0") + F.col("l1") + F.col("l2") + 1e-12) < curvature).alias("flat"))
    rows = cut(rows.select("scan_id", "pt", *AXES, "nx", "ny", "nz").join(flat, ["scan_id", "pt"]))
    edges = grown_edges(rows, radius, k, angle, plane)
    node = lambda c: F.struct("scan_id", F.col(c).alias("pt"))
    found = cut(components(edges.select(node("a").alias("a"), node("b").alias("b"))))
    large = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    labels = cut(found.join(large, "label").select("node.scan_id", "node.pt", F.col("label.pt").alias("label")))
    return spread(rows, labels, radius, angle + 20.0)
