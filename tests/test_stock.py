"""Plans, access, sources and notations on rows made by hand."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lithos.functions import buildup, rings
from lithos.operators import access, parametric, plan
from lithos.session import shared_base
from lithos.sources import tables


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


RING = "array<struct<x:double,y:double>>"


def test_rings(spark):
    l_shape = ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))
    df = spark.createDataFrame([(1, l_shape), (2, ring((0, 0), (0, 10), (10, 10), (10, 0)))], f"id long, ring {RING}")
    r = F.col("ring")
    got = df.select(rings.area(r), rings.perimeter(r), rings.contains(r, F.lit(1.0), F.lit(3.0)), rings.contains(r, F.lit(3.0), F.lit(3.0)), F.round(rings.inset_area(r, F.lit(0.6)), 6), F.round(rings.centroid(r)["x"], 6)).orderBy(F.col("id")).collect()
    assert tuple(got[0])[:4] == (12.0, 16.0, True, False) and got[0][5] == round(5 / 3, 6)
    assert tuple(got[1]) == (100.0, 40.0, True, True, 77.44, 5.0)


def test_a_corner_below_a_gable_is_of_the_ring_above(spark):
    """A point on a sloping upper side is outside, as one on a level upper side is; lower and left sides are inside."""
    gable = ring((0, 0), (12, 0), (12, 10), (6, 13), (0, 10))
    df = spark.createDataFrame([(1, gable), (2, ring((0, 10), (12, 10), (12, 20), (6, 23), (0, 20)))], f"id long, ring {RING}")
    points = spark.createDataFrame([(1, 0.0, 10.0), (2, 2.0, 11.0), (3, 0.0, 5.0), (4, 0.0, 0.0), (5, 6.0, 13.0), (6, 12.0, 5.0)], "pt long, x double, y double")
    assert {r.pt: r.id for r in rings.within(points, df, "pt", "id").collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 2}


def test_touching_skew_edges(spark):
    a, b = ring((0, 0), (30, 40), (0, 40)), ring((0, 0), (30, 0), (30, 40))
    df = spark.createDataFrame([(1, a), (2, b), (3, ring((100, 0), (101, 0), (101, 1)))], f"id long, ring {RING}")
    got = {r.id: round(r.touching, 6) for r in rings.touching(df, "id").collect()}
    assert got == {1: 50.0, 2: 50.0}


def test_balance_of_an_unknown_period(spark):
    """A building of period 0 backs off to the catalog's other periods instead of losing its shell."""
    b = spark.createDataFrame([(1, "0", 9.0), (2, "3", 9.0)], "bw_geb_id long, bp string, maxhoehe double").withColumns({"x0": F.col("bw_geb_id") * 50.0, "y0": F.lit(0.0), "wx": F.lit(10.0), "wy": F.lit(10.0)})
    rows = [(i, "1945-1979", o, a, 100.0, p, m, t) for i, (o, a) in enumerate((o, a) for o in ("KG", "RG", "DG") for a in ("AW", "FB", "D")) for p, (m, t) in enumerate([("Putz", 0.02), ("Ziegel", 0.38)], 1)]
    layers = spark.createDataFrame(rows, "build_id long, bauperiode string, ort string, art string, nettoflaeche double, pos int, material string, thickness double")
    facts = parametric.parametric(b)
    profiles = parametric.profiles(facts, layers)
    got = {(r.bauperiode, r.ort, r.art, r.material): round(r.thickness, 6) for r in profiles.collect()}
    assert got["unbekannt", "RG", "AW", "Ziegel"] == 0.58 and got["unbekannt", "RG", "AW", "Putz"] == 0.02  # T = 0.60
    assert got["1945-1979", "RG", "AW", "Ziegel"] == 0.48 and got["1945-1979", "RG", "FB", "Ziegel"] == 0.38
    shell = {r.bauperiode: r.v for r in parametric.balance(facts, profiles).where("element NOT LIKE 'IW%'").groupBy("bauperiode").agg(F.sum("volume").alias("v")).collect()}
    assert set(shell) == {"unbekannt", "1945-1979"} and all(v > 0 for v in shell.values())
    bare = parametric.balance(facts, profiles.where("art <> 'D'")).where("element = 'DG/D'").collect()
    assert len(bare) == 2 and all(r.material is None and r.volume == 0 for r in bare)


def test_calibration(spark):
    b = spark.createDataFrame([(1, "2", 12.0)], "bw_geb_id long, bp string, maxhoehe double").withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "wx": F.lit(10.0), "wy": F.lit(10.0)})
    c = spark.createDataFrame([(2, "storey_height_m", 4.0), (3, "storey_height_m", 2.0), (2, "unheard_of", 1.0)], "period int, metric string, value double")
    assert parametric.parametric(b, c).first().storeys == 3 and parametric.parametric(b).first().storeys == 4


def test_plan(spark):
    lit = F.lit
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(plan.scale_mm(lit(100.0))) == pytest.approx(35.2777, abs=1e-3) and one(plan.scale_mm(lit(0.0))) is None
    assert one(plan.two_point_mm(lit(5000.0), lit(0.0), lit(0.0), lit(3.0), lit(4.0))) == 1000 and one(plan.run_length(lit(2.0), lit(0.0))) == 0
    polygons = spark.createDataFrame([(1, 1, ring((0, 0), (10, 0), (10, 10), (0, 10)), None, 1000.0), (1, 2, ring((20, 0), (21, 0), (21, 1)), 7.5, None), (2, 1, ring((0, 0), (1, 0), (1, 1)), None, None)], f"plan_id long, polygon_id long, ring {RING}, net_area_m2 double, mm_per_unit double")
    segments = spark.createDataFrame([(1, 5.0, 5.0, 4.0), (1, 15.0, 5.0, 9.0), (2, 5.0, 5.0, 9.0)], "plan_id long, x double, y double, area double")
    assert sorted((r.plan_id, r.polygon_id, r.area_m2) for r in plan.floor_areas(polygons, segments).collect() if r.area_m2) == [(1, 1, 96.0), (1, 2, 7.5)]
    marks = spark.createDataFrame([("Tür", None, 1.0, None, None, 2, True), ("Tür", None, 1.0, None, None, None, False)], "type string, name string, length double, width double, height double, count int, public boolean")
    assert plan.folded(marks).first()["count"] == 3 and plan.folded(marks, "public").count() == 2
    got = one(plan.payload(lit("AW"), lit(1.23456), lit(None).cast("double"), lit(False), lit(True)))
    assert (got.type, got.length, got.area, got.kerndicke, got.nachbarkontakt) == ("wall", 1.235, None, None, True)
    groups = spark.createDataFrame([(1, 1, 2, 10.0), (1, 2, 0, 10.0), (2, 1, 1, None)], "plan_id long, group_id long, n_layers int, mm_per_unit double")
    walls = spark.createDataFrame([(1, 1, 300.0), (1, 1, 200.0), (1, 2, 5.0), (2, 1, 5.0)], "plan_id long, group_id long, length double")
    assert sorted(tuple(r) for r in plan.wall_rows(walls, groups).collect()) == [(1, 1, 5.0), (2, 1, 0.0)]
    moved, left = plan.merged(walls, spark.createDataFrame([(2, 1)], "group_id long, target long"), groups.select("group_id").distinct())
    assert {r.group_id for r in moved.collect()} == {1} == {r.group_id for r in left.collect()}


def test_access(spark):
    buildings = spark.createDataFrame([(1, "u1", "b1", "Gasse 1"), (2, "u2", "b2", " "), (3, "u1", "b3", None)], "id long, user_id string, building_id string, address string")
    parts = spark.createDataFrame([("b1", "u1", 10), ("b2", "u1", 11), ("b2", "u2", 12)], "building_id string, owner_id string, part long")
    assert sorted(r.part for r in access.seed(parts, buildings).collect()) == [10, 12]
    listings = spark.createDataFrame([(1, "b1", "u1", 1, "Ziegel", None), (2, "b2", "u2", 2, "Bitumen", None), (3, "b1", "u2", 1, None, "Tür")], "id long, building_id string, owner_id string, user_building_id long, material string, object_type string")
    good, bad = access.with_address(listings, buildings)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]
    assert [r.id for r in access.by_one_filter(listings, group="Mineralik").collect()] == [1] and access.by_one_filter(listings, owner="u2").count() == 2
    for wrong in ({}, {"owner": "u1", "material": "Ziegel"}):
        with pytest.raises(ValueError):
            access.by_one_filter(listings, **wrong)
    images = spark.createDataFrame([(1, 2, "c"), (1, 0, "b"), (1, 0, "a")], "listing_id long, sort_order int, image_url string")
    assert access.first_images(images).first().image_url == "a"
    names = spark.createDataFrame([(1, "Ärmel"), (2, "zaun"), (None, "x")], "id long, name string")
    assert [r.name for r in access.component_options(names, spark.createDataFrame([(3, "Bau")], "id long, name string")).collect()] == ["Ärmel", "Bau", "zaun"]
    flags = spark.createDataFrame([("u1", None), ("u2", True), ("u2", None), (None, None)], "owner string, public boolean")
    assert [r[0] for r in flags.select(access.can_read(F.col("owner"), F.col("public"), "u1")).collect()] == [True, True, False, False]
    assert access.survivors(parts, buildings.where("id = 1"), "building_id").count() == 1
    lost, twice = access.orphans(parts, buildings, "building_id")
    assert lost.count() == 0 and [r.building_id for r in twice.collect()] == ["b2"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nend_header\n0.01 0.01 0.01\n0.03 0.03 0.03 255\n1 1 1e0\n")
    assert sorted((round(r.x, 4), round(r.z, 4)) for r in tables.ascii_points(spark, f"file://{tmp_path}/a.ply").collect()) == [(0.02, 0.02), (1.0, 1.0)]
    shape = {"type": "FeatureCollection", "features": [{"properties": {"typ": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"properties": {"typ": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "t.geojson").write_text(json.dumps(shape))
    got = tables.geojson_polygons(spark, f"file://{tmp_path}/t.geojson", "typ:string").select("typ", rings.area(F.col("ring")).alias("a")).collect()
    assert sorted(tuple(r) for r in got) == [("A", 0.5), ("B", 0.5), ("B", 2.0)]
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in {"1": '{"id": "1", "updatedAt": "2024-01-01"}', "2": '{"id": "2", "updatedAt": "2024-02-01"}', "3": '{"id": '}.items():
        (docs / f"{name}.json").write_text(text)
    assert [r.id for r in tables.plan_documents(spark, f"file://{docs}", "id string, updatedAt string").collect()] == ["2", "1"]
    frame = spark.createDataFrame([(1, "x"), (2, None)], "a int, mat string")
    tables.write_csv(frame, f"file://{tmp_path}/c", compressed=True)
    assert [tuple(r) for r in tables.catalog_csv(spark, f"file://{tmp_path}/c", ["n", "mat"]).collect()] == [(1, "x")]
    for _ in range(2):
        tables.refresh(frame, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == 2


@pytest.mark.parametrize(("line", "measured", "want"), [
    ("Putz 15 Ziegel _ Putz 15", 280.0, [("Putz", 15.0), ("Ziegel", 250.0), ("Putz", 15.0)]),
    ("Putz 15 Ziegel _", None, [("Putz", 15.0), ("Ziegel", 50.0)]),
    ("zie 12,5 Dübel 9", None, [("Ziegel", 13.0), ("Dübel", 0.0)]),
    ("Putz 15 Wolke 3", None, None),
    ("Putz", None, [("Putz", 15.0)]),
    ("Ziegel Putz", 400.0, [("Ziegel", 300.0), ("Putz", 15.0)]),
    ("Schaum _ Putz _ Schaum _", 100.0, [("Schaum", 33.0), ("Putz", 33.0), ("Schaum", 33.0)]),
    ("Schaum", None, [("Schaum", 50.0)]),
    ("Dübel _ Putz _", 20.0, [("Dübel", 0.0), ("Putz", 20.0)]),
    ("Putz 15 20", None, None),
    ("feiner Putz 15", None, None),
    ("Putz 500 Ziegel _", 100.0, [("Putz", 500.0), ("Ziegel", 0.0)]),
    ("  ", None, None),
    (None, None, None),
])
def test_buildup(spark, line, measured, want):
    df = spark.createDataFrame([(line, measured)], "line string, mm double")
    got = df.select(buildup.parsed(F.col("line"), F.col("mm"), ["Putz", "Ziegel", "Schaum"], ["Dübel"]).alias("x")).first().x
    assert (None if got is None else [tuple(r) for r in got]) == want


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1024]", "yarn"])
def test_no_scratch_folder_on_a_cluster(master):
    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_base(session)
    conf["spark.checkpoint.dir"] = "hdfs://name/shared/"
    assert shared_base(session) == "hdfs://name/shared"
