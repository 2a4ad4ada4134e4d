"""Point clouds against plain numpy, and golden surfaces, corners and storeys."""

import numpy as np
import pytest

from lithos.functions.profiles import maxima, peaks, prominence, smoothed
from lithos.operators import clouds, storeys
from lithos.operators.components import components


def frame(spark, scans, parts=4):
    rows = [(s, int(i), *map(float, p)) for s, xyz in scans.items() for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "scan_id long, pt long, x double, y double, z double").repartition(parts)


def distances(xyz):
    return np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))


def test_mean_distances_and_outliers(spark):
    """A dense block, an even sheet, a far point that needs wider halos, copies of one point, and a scan below k points."""
    rng = np.random.default_rng(1)
    scans = {
        1: np.concatenate((rng.random((300, 3)) * 0.3, rng.random((200, 3)) * 6, [[90.0, -40.0, 3.0]])),
        2: np.concatenate(([[0.0, 0.0, 0.0]] * 30, rng.random((10, 3)))),
        3: rng.random((7, 3)) * 50,
        4: np.zeros((1, 3)),
    }
    got = {(r["scan_id"], r["pt"]): (r["mean_distance"], r["inlier"]) for r in clouds.outliers(frame(spark, scans), 12, 2.0, 0.25).collect()}
    assert len(got) == sum(map(len, scans.values()))
    for s, xyz in scans.items():
        mean = np.sort(distances(xyz), 1)[:, :12].mean(1)
        limit = mean.mean() + 2.0 * mean.std(ddof=1) if len(mean) > 1 else np.nan
        for i, m in enumerate(mean):
            assert got[s, i][0] == pytest.approx(m, abs=1e-12)
            assert got[s, i][1] == bool(m > 0 and m < limit)
    assert not got[1, 500][1]
    kept = clouds.cleaned(frame(spark, scans), 12, 2.0, 0.25)
    assert kept.where("scan_id = 1").agg({"x": "min"}).first()[0] == 0.0


def test_surfaces_equal_eigh(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate((rng.random((150, 3)), np.c_[rng.random((80, 2)), np.zeros(80)], np.c_[np.linspace(3, 4, 40), np.zeros(40), np.zeros(40)], [[9.0, 9, 9], [9.1, 9, 9]]))
    got = {r["pt"]: r for r in clouds.surfaces(frame(spark, {1: xyz}), 0.3, 15).collect()}
    for i, d in enumerate(distances(xyz)):
        near = np.lexsort((np.arange(len(d)), d))[:15]
        near = near[d[near] <= 0.3]
        c = np.cov(xyz[near].T, bias=True) if len(near) >= 3 else np.eye(3)
        value, vector = np.linalg.eigh(c)
        assert got[i]["planarity"] == pytest.approx((value[1] - value[0]) / (value[2] + 1e-9), abs=1e-6)
        assert got[i]["curvature"] == pytest.approx(max(value[0], 0) / (value.sum() + 1e-12), abs=1e-6)
        n = np.array([got[i][c] for c in ("nx", "ny", "nz")])
        assert np.linalg.norm(n) == pytest.approx(1.0)
        if len(near) >= 3 and value[1] - value[0] > 1e-4:
            assert abs(n @ vector[:, 0]) == pytest.approx(1.0, abs=1e-6)
        if len(near) < 3:
            assert tuple(n) == (0.0, 0.0, 1.0)


def sheet(origin, u, v, nu, nv, step=0.1):
    i, j = np.meshgrid(np.arange(nu), np.arange(nv), indexing="ij")
    return np.asarray(origin) + step * (i.reshape(-1, 1) * np.asarray(u) + j.reshape(-1, 1) * np.asarray(v))


def test_planar_segments(spark):
    """Two walls at a corner stay apart, a wall at 37 degrees is one segment, noise has no label; holes are filled."""
    t = np.radians(37)
    walls = [sheet((0, 0, 0), (1, 0, 0), (0, 0, 1), 25, 20), sheet((0, 0.1, 0), (0, 1, 0), (0, 0, 1), 25, 20), sheet((10, 10, 0), (np.cos(t), np.sin(t), 0), (0, 0, 1), 25, 20)]
    noise = np.random.default_rng(3).random((20, 3)) * 2 + [30, 30, 30]
    xyz = np.concatenate((*walls, noise))
    rows = clouds.surfaces(frame(spark, {5: xyz, 6: walls[2]}), 0.25, 40).cache()
    got = {(r["scan_id"], r["pt"]): r["label"] for r in clouds.planar_segments(rows).collect()}
    label = np.array([got.get((5, i), -1) for i in range(len(xyz))])
    sizes = [np.unique(label[k * 500 : (k + 1) * 500], return_counts=True) for k in range(3)]
    main = [s[0][s[1].argmax()] for s in sizes]
    assert len(set(main)) == 3 and -1 not in main
    assert all(s[1].max() >= 440 for s in sizes) and sizes[2][1].tolist() == [500]
    assert set(label[1500:]) == {-1}
    assert {got[6, i] for i in range(500)} == {0}


def plain_spread(xyz, n, labels, radius, angle, k, rounds):
    labels, d, least = labels.copy(), distances(xyz), np.cos(np.radians(angle))
    for _ in range(rounds):
        known, new = np.flatnonzero(labels >= 0), labels.copy()
        for u in np.flatnonzero(labels < 0):
            near = known[np.lexsort((known, d[u, known]))][:k]
            ok = near[(d[u, near] <= radius) & (np.abs(n[near] @ n[u]) >= least)]
            if len(ok):
                new[u] = labels[ok[0]]
        if (new == labels).all():
            break
        labels = new
    return labels


@pytest.mark.parametrize("parts", [1, 7])
def test_spread_equals_a_loop(spark, parts):
    rng = np.random.default_rng(4)
    xyz, n = rng.random((150, 3)) * [3, 1, 1], rng.normal(size=(150, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    labels = np.where(xyz[:, 0] < 0.5, rng.integers(0, 3, 150), -1)
    rows = spark.createDataFrame([(1, i, *map(float, xyz[i]), *map(float, n[i])) for i in range(150)], "scan_id long, pt long, x double, y double, z double, nx double, ny double, nz double").repartition(parts)
    start = spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(labels) if x >= 0], "scan_id long, pt long, label long")
    for rounds in (1, 4):
        got = {r["pt"]: r["label"] for r in clouds.spread(rows, start, 0.4, 60, 8, rounds).collect()}
        want = plain_spread(xyz, n, labels, 0.4, 60, 8, rounds)
        assert got == {i: int(x) for i, x in enumerate(want) if x >= 0}


def test_components_of_a_chain(spark):
    """A chain of 3,000 nodes in shuffled order, a ring, and self-links."""
    order = np.random.default_rng(5).permutation(3000)
    edges = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:])] + [(4000, 4001), (4001, 4002), (4002, 4000), (5000, 5000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 4000 for i in (4000, 4001, 4002)}


def test_profiles():
    assert maxima([0, 1, 0, 2, 2, 2, 0, 3, 3, 1, 5]).tolist() == [1, 4, 7]
    v = np.array([0, 5, 3, 4, 0, 9, 8, 8.5, 0], float)
    p = maxima(v)
    assert p.tolist() == [1, 3, 5, 7] and prominence(v, p).tolist() == [5, 1, 9, 0.5]
    assert peaks(v, distance=3).tolist() == [1, 5] and peaks(v, least_prominence=1).tolist() == [1, 3, 5] and peaks(v, height=5).tolist() == [1, 5, 7]
    assert peaks([0, 2, 0, 2, 0], distance=3).tolist() == [3]
    assert peaks([]).tolist() == [] and smoothed(np.array([]), 1).tolist() == []
    flat = smoothed(np.full(5, 3.0), 1.0)
    assert flat == pytest.approx(np.full(5, 3.0))
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    assert smoothed(np.array([0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0.0]), 1.0)[1:10] == pytest.approx(w / w.sum())


def storey_points(levels, top):
    """Horizontal sheets of 6 by 6 metres at the levels, and a wall over the whole height."""
    xy = sheet((0, 0, 0), (1, 0, 0), (0, 1, 0), 30, 30, 0.2)
    flat = np.concatenate([xy + [0, 0, z] for z in levels])
    wall = sheet((0, 0, 0), (1, 0, 0), (0, 0, 1), 60, int(top / 0.1) + 1)
    return [(*p, True) for p in flat] + [(*p, False) for p in wall]


def test_storeys(spark):
    """Floors at 0.1, 3.1 and 6.2, ceilings at 2.6 and 5.7 that are too near to be floors, a roof without a level of its own."""
    rows = [(1, *map(float, p[:3]), p[3]) for p in storey_points([0.1, 2.6, 3.1, 5.7, 6.2, 6.2], 8.0)]
    rows += [(2, 0.1 * i, 0.0, 0.1 * i, True) for i in range(40)] + [(3, 0.0, 0.0, 0.1, True), (3, 1.0, 1.0, 0.2, True)]
    points = spark.createDataFrame(rows, "scan_id long, x double, y double, z double, horizontal boolean").repartition(5)
    levels = storeys.storeys(points)
    got = sorted(map(tuple, levels.collect()))
    first = [r for r in got if r[0] == 1]
    assert [r[2] for r in first] == pytest.approx([0.125, 3.125, 6.225], abs=0.06)
    assert [r[3] for r in first][:2] == pytest.approx([2.625, 5.725], abs=0.06) and first[2][3] is None
    assert first[0][4] == 0.0 and first[0][5] == first[1][4] == pytest.approx(first[1][2] - 0.15)
    assert first[2][5] == pytest.approx(8.0, abs=1e-3)
    assert [r for r in got if r[0] == 2] == [(2, 0, None, None, 0.0, pytest.approx(3.9, abs=1e-3))]
    assert not [r for r in got if r[0] == 3]
    dealt = storeys.with_storey(points, levels)
    assert dealt.where("scan_id = 1 AND storey IS NULL").isEmpty() and dealt.count() == len(rows)
    assert dealt.where("scan_id = 3 AND storey IS NOT NULL").isEmpty()


def test_masks(spark):
    """A room: floor, ceiling, four walls and a sloping sheet."""
    room = [sheet((0, 0, 0), (1, 0, 0), (0, 1, 0), 40, 40), sheet((0, 0, 3), (1, 0, 0), (0, 1, 0), 40, 40)]
    walls = [sheet((0, 0, 0.1), (1, 0, 0), (0, 0, 1), 40, 29), sheet((0, 4, 0.1), (0.995, 0.0998, 0), (0, 0, 1), 40, 29)]
    slope = [sheet((10, 0, 1), (0.8, 0, 0.6), (0, 1, 0), 20, 20)]
    xyz = np.concatenate((*room, *walls, *slope))
    rows = clouds.surfaces(frame(spark, {1: xyz}), 0.25)  # not a multiple of the step, where rounding decides
    levels = storeys.floor_and_ceiling(rows)
    z = levels.first()
    assert z["z_floor"] == pytest.approx(0.0, abs=0.06) and z["z_ceiling"] == pytest.approx(3.0, abs=0.06)
    got = {r["pt"]: r for r in storeys.masks(rows, levels).collect()}
    share = lambda mask, lo, hi: np.mean([got[i][mask] for i in range(lo, hi)])
    n = [0, *np.cumsum([len(room[0]), len(room[1]), len(walls[0]), len(walls[1]), len(slope[0])])]
    assert share("floor_band", n[0], n[1]) > 0.85 and share("ceil_band", n[1], n[2]) > 0.85 and share("floor_band", n[1], n[5]) < 0.05
    assert share("wall", n[2], n[3]) > 0.6 and share("wall", n[3], n[4]) > 0.6 and share("wall", n[0], n[2]) == 0
    assert share("roof", n[4], n[5]) > 0.9
    assert got[0]["const_height"] == pytest.approx(2.7, abs=0.1)
