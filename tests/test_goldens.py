"""Values derived by hand from the rules."""

import hashlib
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lithos.functions import layers as ly
from lithos.functions import periods
from lithos.functions import numbers as nb
from lithos.functions.periods import collapse_bp
from lithos.operators import components, market, markov, parametric, structure, thickness

CELL = ("1980-1999", "RG", "AW")


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).collect()[0][0]


@pytest.mark.parametrize(("bp", "code"), [("0", 0), ("0,1", 1), ("0,2", 2), ("0,1,2", 1), ("2,4", 2), (None, 0), ("x, 3", 3)])
def test_collapse_bp(spark, bp, code):
    assert spark.createDataFrame([(bp,)], "bp string").select(collapse_bp(F.col("bp"))).collect()[0][0] == code


def test_three_squares(spark):
    b = spark.createDataFrame([(1, "0,2", 12.0, 0.0), (2, "2", 12.0, 10.0), (3, "0,5", 9.0, 20.0)], "bw_geb_id long, bp string, maxhoehe double, x0 double").withColumns({"y0": F.lit(0.0), "wx": F.lit(10.0), "wy": F.lit(10.0)})
    got = parametric.parametric(b).orderBy("bw_geb_id").collect()
    assert [r.storeys for r in got] == [4, 4, 3]
    assert [r.net_area_m2 for r in got] == [77.44, 77.44, 86.49]
    assert [r.touching_m for r in got] == [10, 20, 10] and [r.free_m for r in got] == [30, 20, 30]
    assert [r.interior_m for r in got] == [38.72, 38.72, 50.16]
    assert [r.percentage_wall for r in got] == [0.2256, 0.2256, 0.1351]
    assert {r.roof_area_m2 for r in got} == {120.0} and {r.length_m for r in got} == {10.0}


@pytest.mark.parametrize(("text", "value"), [("10,5", 10.5), ("beliebig", float("inf")), ("abc", None), ("1.234,5 €", 1234.5), ("1.234", 1234.0), ("150000", 150000.0), (None, None)])
def test_user_number(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(nb.parse_user_number(F.col("t"))).collect()[0][0] == value


def test_api_number_and_units(spark):
    assert one(spark, nb.parse_api_number(F.col("t")), t="3.000") == 3.0
    assert one(spark, nb.parse_api_number(F.col("t")), t="x") is None
    assert one(spark, nb.canonical_unit(F.col("t")), t="StÃ¼ck") == "Stück"
    assert str(one(spark, nb.date_only(F.col("t")), t="2026-06-01T10:00")) == "2026-06-01" and one(spark, nb.date_only(F.col("t")), t="soon") is None


@pytest.mark.parametrize(("low", "high", "want"), [("10,5", "beliebig", (10.5, float("inf"))), ("abc", "def", (0.0, float("inf"))), ("beliebig", "1000", (0.0, 1000.0)), ("20", "5", (5.0, 20.0))])
def test_price_range(spark, low, high, want):
    a, b = nb.price_range(nb.parse_user_number(F.lit(low)), nb.parse_user_number(F.lit(high)))
    assert tuple(spark.range(1).select(a, b).collect()[0]) == want


def test_listing_units(spark):
    rows = [("a", "Objekt", 3.0, "Stück"), ("b", "Objekt", 8.0, "m"), ("c", "Objekt", 5.0, "Stück"), ("d", "Bauteil", 5.0, "kg")]
    df = spark.createDataFrame(rows, "id string, component_category string, quantity double, unit string").withColumns({"status": F.lit("verbaut"), "price": F.lit(1.0)})
    assert [r.id for r in market.filtered(df.where("component_category = 'Objekt'"), quantity=4).collect()] == ["c"]
    assert [r.id for r in market.filtered(df, quantity=4, unit="kg").collect()] == ["d"]


def test_structure_rules(spark):
    types = lambda *x: one(spark, structure.allowed_types(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")))
    assert types("flat") == ["A", "DA"] and types() == [] and types("KG") == ["IW", "AW", "BW", "BA"] and types("KG", "pitched") == ["BA"]
    layer = lambda *x: F.array(*[F.struct(F.lit(m).alias("material"), F.lit(t).alias("thickness")) for m, t in x])
    ok = lambda *x: one(spark, structure.valid_part(F.lit(2.0), layer(*x), ["geklebt"]))
    assert not ok(("geklebt", 5.0)) and ok(("geklebt", 5.0), ("Ziegel", 240.0)) and not ok(("Ziegel", 0.5))
    s = F.struct(F.lit(3).alias("count"), F.lit(270).alias("height"), F.lit(0).alias("area"))
    assert one(spark, structure.storey_summary(s)) == "(3x, 270 cm)"


def test_import_is_not_doubled(spark):
    stored = spark.createDataFrame([("m", None)], "name string, source_extract_id string")
    new = spark.createDataFrame([("a", "e"), ("b", "e")], stored.schema)
    first, c1 = structure.reallocate(stored, new)
    second, c2 = structure.reallocate(first, new)
    assert [tuple(r) for r in c1.collect()] == [("e", 0, 2)] and [tuple(r) for r in c2.collect()] == [("e", 2, 2)]
    assert sorted(r.name for r in second.collect()) == ["a", "b", "m"]


def test_reservation(spark):
    key = ["owner", "name", "size"]
    open_ = spark.createDataFrame([("id1", "o", "f", 1, None), ("id2", "o", "g", 1, "url")], "id string, owner string, name string, size int, file_url string")
    asked = spark.createDataFrame([("o", "f", 1), ("o", "f", 2), ("o", "g", 1)], "owner string, name string, size int")
    got = {(r.name, r.size): r.id for r in structure.reserved(open_, asked, key).collect()}
    assert got["f", 1] == "id1" and len(set(got.values())) == 3 and got["g", 1] != "id2"


def test_merge_moves_updated_at_only_on_change(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, None, "t0")], "id int, v string, updated_at string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    got = {r.id: (r.v, r.updated_at) for r in structure.merge_updates(old, new, "id", ["v"], F.lit("t1")).collect()}
    assert got[1] == ("a", "t0") and got[2] == ("b", "t1") and 3 in got


def test_extract_id(spark):
    h = bytearray(hashlib.sha256(b"doc|RG 1").digest()[:16])
    h[6], h[8] = h[6] & 15 | 64, h[8] & 63 | 128
    assert one(spark, nb.name_uuid(F.lit("doc|RG 1"))) == str(uuid.UUID(bytes=bytes(h)))


def test_buildup_strings(spark):
    df = spark.createDataFrame([("(Putz, 0.015; IPE, 30.00x14.20; Folie; Ziegel, ca, 0.16)",), ("()",), (None,)], "m string")
    got = df.select(ly.parse_materials(F.col("m")).alias("a"), ly.parse_layers(F.col("m")).alias("b")).collect()
    assert got[0].a == ["Putz", "Folie", "Ziegel"] and [tuple(x) for x in got[0].b] == [("Putz", 0.015), ("Ziegel", 0.16)]
    assert got[1].a == [] and got[2].a is None


@pytest.fixture(scope="module")
def seqs(spark):
    data = [(i, *CELL, 10.0, s) for i, s in enumerate([["STB", "Styropor", "Putz"]] * 3 + [["Putz", "Ziegel", "Putz"]] * 2 + [["STB", "Putz"]])]
    return spark.createDataFrame(data, "build_id long, bauperiode string, ort string, art string, nettoflaeche double, seq array<string>").withColumn("w", F.lit(10.01))


def test_plausibility(spark, seqs):
    asks = [(1, ["STB", "Styropor", "Putz"]), (2, ["Putz", "Styropor", "STB"]), (3, ["STB", "Karton", "Putz"]), (4, ["Styropor", "STB"])]
    req = spark.createDataFrame([(i, *CELL, s) for i, s in asks], "req_id long, bauperiode string, ort string, art string, seq array<string>")
    got = {r.req_id: r for r in markov.check(req, seqs).collect()}
    assert got[1].tier == 3 and not got[1].reversed
    assert got[2].tier == 2 and got[2].reversed
    assert got[3].tier == 2 and got[3].unknown
    assert got[4].tier in (1, 2)


def test_translation_and_beam(spark, seqs):
    dists = markov.distributions(seqs)
    req = spark.createDataFrame([(1, *CELL, ["Beton", "Styropor", "Putz"]), (2, *CELL, ["Blei"])], "req_id long, bauperiode string, ort string, art string, seq array<string>")
    got = {r.req_id: r.seq for r in markov.translate(req, dists).collect()}
    assert got[1] == ["STB", "Styropor", "Putz"] and got[2] == ["Metall"]
    beam = markov.beam_predict(seqs, dists).orderBy("rank").collect()
    assert beam[0].seq == "STB;Styropor;Putz" and sum(r.share for r in beam) == pytest.approx(1)


def test_leave_one_out(spark):
    rows = [(i, *CELL, 0.99, 1, "Putz", t) for i, t in enumerate([0.01, 0.02, 0.06])]
    df = spark.createDataFrame(rows, "build_id long, bauperiode string, ort string, art string, nettoflaeche double, pos int, material string, thickness double")
    got = {r.build_id: r.seq_mean for r in thickness.leave_one_out(df).collect()}
    assert got[0] == pytest.approx(0.04) and got[2] == pytest.approx(0.015)


def test_components(spark):
    e = spark.createDataFrame([Row(a=i, b=i + 1) for i in range(12)] + [Row(a=50, b=51)])
    got = {r.node: r.label for r in components.components(e).collect()}
    assert {got[i] for i in range(13)} == {0} and got[51] == 50


def test_reservation_after_each_file(spark):
    """A key with one file gets another id than the file's, and with two another again; two at once get the same."""
    key, kind = ["owner", "name", "size"], "id string, owner string, name string, size int, file_url string"
    asked = spark.createDataFrame([("o", "f", 1), ("o", "f", 1), ("o|f", "", 1), ("o", "|f", 1), (None, "f", 1)], "owner string, name string, size int")
    rows, seen = spark.createDataFrame([], kind), []
    for _ in range(3):
        got = structure.reserved(rows, asked, key).collect()
        assert len(got) == 5 and len({r.id for r in got}) == 4 and len({r.id for r in got if (r.owner, r.name) == ("o", "f")}) == 1
        seen.append(got[0].id if (got[0].owner, got[0].name) == ("o", "f") else next(r.id for r in got if (r.owner, r.name) == ("o", "f")))
        rows = rows.unionByName(spark.createDataFrame([(seen[-1], "o", "f", 1, "url")], kind))
    assert len(set(seen)) == 3


def test_merge_keeps_all_columns_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", "x", "t0"), (None, "n", "y", "t0")], "id int, v string, other string, updated_at string")
    new = spark.createDataFrame([(1, "b"), (None, "n"), (2, "c")], "id int, v string")
    once = structure.merge_updates(old, new, "id", ["v"], F.lit("t1"))
    want = {(1, "b", "x", "t1"), (None, "n", "y", "t0"), (2, "c", None, "t1")}
    assert {tuple(r) for r in once.collect()} == want and once.count() == 3
    again = structure.merge_updates(once, new, "id", ["v"], F.lit("t2"))
    assert {tuple(r) for r in again.collect()} == want and again.count() == 3


def test_rules_of_values(spark):
    """Unit spellings, the slider's ends, error lines, period labels, layers without a material."""
    assert [one(spark, nb.canonical_unit(F.lit(u))) for u in (" m2 ", "m³", "kg", "Meter", "KG", "stk", "m")] == ["Quadratmeter", "Kubikmeter", "Kilogramm", "Meter", None, None, None]
    options = [0.0, 10.0, 100_000.0]
    slider = lambda v, unbounded=True: one(spark, nb.slider_index(F.lit(float(v)), options, unbounded))
    assert [slider(v) for v in (5, 6, 100_000, 100_001, 250_000, "inf", -4)] == [0, 1, 2, 3, 3, 3, 0]
    assert [slider(v, False) for v in (100_000, 250_000, "inf")] == [2, 2, 2]
    line = lambda t: one(spark, nb.first_error_line(F.lit(t), F.lit("ValueError")))
    assert line("cannot open /srv/a-b/x_1.laz: gone\nat /etc") == "cannot open : gone" and line("C:\\tmp\\x.py") == "ValueError"
    assert line("") == line(None) == line("/a/b") == "ValueError" and line("  bad  ") == "bad" and line("x" * 300) == "x" * 200
    label = lambda best, bp: one(spark, periods.label_or_list(F.lit(best).cast("int"), F.lit(bp).cast("string")))
    assert label(0, "1,2") == "unbekannt" and label(9, "1") == "unbekannt" and label(None, "1, 1,7,x") == "bis 1918, bis 1918, unbekannt, unbekannt"
    assert label(None, None) == label(None, "") == "unbekannt"
    layers = lambda *x: F.array(*[F.struct(F.lit(m).cast("string").alias("material"), F.lit(t).cast("double").alias("thickness")) for m, t in x])
    ok = lambda *x: one(spark, structure.valid_part(F.lit(2.0), layers(*x), ["geklebt"]))
    assert ok(("Ziegel", 240.0)) and not ok(("Ziegel", 240.0), (None, 10.0)) and not ok(("Ziegel", 240.0), ("", 10.0)) and not ok(("Ziegel", 240.0), ("Putz", None))


def test_filter_needs_a_price_and_a_unit(spark):
    rows = [("a", "Objekt", 3.0, "Stück", 10.0), ("b", "Objekt", 8.0, "m", 10.0), ("c", "Bauteil", 5.0, "kg", None), ("d", "Bauteil", 5.0, "kg", 7.0), ("e", "Bauteil", None, "Meter", 7.0)]
    df = spark.createDataFrame(rows, "id string, component_category string, quantity double, unit string, price double").withColumn("status", F.lit("verbaut"))
    ids = lambda **k: sorted(r.id for r in market.filtered(df, **k).collect())
    assert ids() == ["a", "d", "e"] and ids(unit="kg") == ["d"] and ids(quantity=1) == ["a", "d"] and ids(price=(20, 8)) == ["a"] and ids(unit="Palette") == ["a", "d", "e"]
