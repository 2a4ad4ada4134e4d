"""Wall fragments: goldens, and links and groups against all pairs in plain Python."""

import math
import random

import pytest

from lithos.operators import fragments as fr

SCHEMA = "scan_id long, id long, x1 double, y1 double, x2 double, y2 double, z_base double, height double, thickness double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def wall(i, x, y, length, angle, z=0.0, h=2.5, t=0.1, scan=1):
    a = math.radians(angle)
    return (scan, i, float(x), float(y), x + length * math.cos(a), y + length * math.sin(a), z, h, t)


def test_goldens(spark):
    rows = [
        wall(1, 0, 0, 2, 0), wall(2, 2.5, 0.1, 2, 0), wall(3, 5.5, 0, 1, 0),  # 1 and 2 on one line, 3 a metre further
        wall(4, 0, 3, 2, 37), wall(5, 2.2 * math.cos(math.radians(37)), 3 + 2.2 * math.sin(math.radians(37)), 2, 37),
        wall(6, 20, 0, 2, 0), wall(7, 22, 0, 1, 0, z=2.0, h=0.5),  # a lintel stays by itself
        wall(8, 30, 0, 2, 178), wall(9, 28, 0.05, -2 + 4, 2),  # on both sides of direction 0
        wall(1, 0, 0, 2, 0, scan=2), wall(2, 0, 0, 2, 0, scan=2), wall(3, 2.5, 0, 2, 0, scan=2),  # equal ones
        (1, 99, None, 0.0, 1.0, 1.0, 0.0, 1.0, 0.1),
    ]
    got = {(r.scan_id, r.id): r for r in fr.joined_fragments(frame(spark, rows)).collect()}
    assert {k: r.n_fragments for k, r in got.items()} == {(1, 1): 2, (1, 3): 1, (1, 4): 2, (1, 6): 1, (1, 7): 1, (1, 8): 2, (2, 1): 3}
    one = got[1, 1]
    assert [one.x1, one.y1, one.x2, one.y2] == pytest.approx([0, 0.05, 4.5, 0.05]) and (one.z_base, one.height) == (0, 2.5)
    assert math.hypot(got[1, 4].x2 - got[1, 4].x1, got[1, 4].y2 - got[1, 4].y1) == pytest.approx(4.2)
    assert fr.joined_fragments(frame(spark, [])).count() == 0


def test_faces(spark):
    rows = [wall(1, 0, 0, 4, 0), wall(2, 0.1, 0.3, 4, 0), wall(3, 0, 2, 4, 0), wall(4, 1, 0.35, 0.5, 0), wall(5, 10, 0, 4, 90, t=0.2), wall(6, 10.1, 0, 4, 90)]
    got = {r.id: r for r in fr.joined_faces(frame(spark, rows)).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1].n_fragments == 2  # a short wall in front of a long one stays
    assert got[1].thickness == pytest.approx(0.3) and got[1].y1 == pytest.approx(0.15) and got[1].x2 == pytest.approx(4.1)
    assert got[5].thickness == pytest.approx(0.2)


@pytest.mark.parametrize("joined, faces", [(fr.joined_fragments, False), (fr.joined_faces, True)])
def test_against_all_pairs(spark, joined, faces):
    r = random.Random(3)
    rows = [wall(i, r.uniform(-20, 20), r.uniform(-20, 20), r.choice([0.3, 1, 3, 12]), r.choice([0, 4, 37, 90, 175, 179]) + r.uniform(-3, 3), r.choice([0.0, 0.5, 2.0]), r.choice([0.5, 2.5])) for i in range(1000)]

    def linked(a, b):
        da, db = (math.atan2(w[5] - w[3], w[4] - w[2]) % math.pi for w in (a, b))
        apart = abs(da - db)
        if math.degrees(min(apart, math.pi - apart)) > 12:
            return False
        m = (da + db) / 2 + (math.pi / 2 if apart > math.pi / 2 else 0)
        c, s = math.cos(m), math.sin(m)
        (a0, a1), (b0, b1) = (sorted((w[2] * c + w[3] * s, w[4] * c + w[5] * s)) for w in (a, b))
        off = abs((b[3] + b[5] - a[3] - a[5]) / 2 * c - (b[2] + b[4] - a[2] - a[4]) / 2 * s)
        common = min(a1, b1) - max(a0, b0)
        if faces:
            return off <= 0.4 and common > 0 and common >= 0.4 * (max(a1, b1) - min(a0, b0))
        return off <= 0.2 and -common <= 0.8 and abs(a[6] - b[6]) <= 1.2 and abs(a[6] + a[7] - b[6] - b[7]) <= 3

    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n = 0
    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[j], rows[i]):
                n += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    sizes = {}
    for i in range(len(rows)):
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    got = {x.id: x.n_fragments for x in joined(frame(spark, rows)).collect()}
    assert n > 90 and got == sizes


def test_pairs_are_few_and_found_once(spark):
    """A link is one row without being made distinct, also between a long wall and short ones, and links are reduced to forests."""
    rows = [wall(i, i * 0.5, 0.1 * (i % 2), 2, i % 5) for i in range(300)] + [wall(1000, 0, 0, 170, 0)]
    links = fr.collinear_links(fr._figures(frame(spark, rows)))
    assert "HashAggregate" not in links._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in links.collect()]
    assert len(found) == len(set(found)) > 1000 and all(a < b for _, a, b in found)
    kept = fr._forest(links).collect()
    assert len(kept) < 301 and {r.n_fragments for r in fr.joined_fragments(frame(spark, rows)).collect()} == {301}


def test_scans_of_many_links_are_put_together(spark, monkeypatch):
    """A task whose forest does not fit a block leaves the rest to the components."""
    rows = [wall(i, (i // 2) * 10, 0.1 * (i % 2), 2, 0) for i in range(300)]
    monkeypatch.setattr(fr, "BLOCK", 20)
    links = fr.face_links(frame(spark, rows)).repartition(1)
    assert not fr._forest(links).where("NOT whole").isEmpty()
    assert {x.id: x.n_fragments for x in fr.joined_faces(frame(spark, rows)).collect()} == {i: 2 for i in range(0, 300, 2)}


def test_a_fragment_is_shuffled_about_once(spark):
    """Not once for each of its neighbouring directions, classes and cells; links of a scan are whole in its task."""
    r = random.Random(2)
    rows = [wall(i, r.uniform(0, 100), r.uniform(0, 12), r.uniform(0.1, 5), r.choice([0, 5, 37, 90])) for i in range(2000)]
    rows = fr._figures(frame(spark, rows))
    far = lambda length: length * 0.43 + 0.4
    assert fr._tiles(rows, far, 5.0).count() < 1.3 * 2000
    forest = fr._forest(fr.face_links(rows))
    found = forest.collect()
    assert all(x.whole and x.a < x.b for x in found) and len({x.b for x in found}) == len(found) > 100
    assert not {x.a for x in found} & {x.b for x in found}


@pytest.mark.parametrize("links", [fr.collinear_links, fr.face_links])
def test_links_do_not_hang_on_tiles(spark, monkeypatch, links):
    """Small tiles of several sizes, small blocks of pairs, and equal fragments: the links of one tile."""
    r = random.Random(8)
    rows = [wall(i, r.uniform(-30, 30), r.uniform(-6, 6), r.choice([0.3, 1, 3, 12, 60]), r.choice([0, 4, 90, 175, 179]) + r.uniform(-3, 3), scan=i % 2) for i in range(600)]
    rows += [(*w[:1], 1000 + w[1], *w[2:]) for w in rows[:100]]
    monkeypatch.setattr(fr, "TILE_LENGTH", 1e4)
    whole = sorted(map(tuple, links(frame(spark, rows)).collect()))
    for name, value in {"TILE_LENGTH": 0.5, "BLOCK": 50, "FRAGMENTS_A_TASK": 40}.items():
        monkeypatch.setattr(fr, name, value)
    assert sorted(map(tuple, links(frame(spark, rows)).collect())) == whole and len(set(whole)) == len(whole) > 150
