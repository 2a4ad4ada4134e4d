"""Rules of stored rows: each one broken alone, unknown results, rejection and repeated keys."""

import pytest
from pyspark.sql import functions as F

from lithos.operators import rules

MARKET = "id long, building_id string, owner_id long, user_building_id long, component_id long, component_category string, location string, material string, object_type string, name string, address string, price double, status string, available_from string, potential string, quantity double, unit string, contact string, length double, width double, height double"
PART = dict(id=0, building_id="b", owner_id=1, user_building_id=1, component_id=1, component_category="Bauteil", location="RG", material="Ziegel", object_type=None, name="n", address="a", price=0.0, status="verbaut", available_from="2026-01-01", potential="reuse", quantity=1.0, unit="Stück", contact="c", length=None, width=1.0, height=None)
CASES = [
    ({}, []),
    ({"component_category": "Objekt", "material": None, "object_type": "Tür", "location": None}, []),
    ({"location": None}, ["location_of_parts"]),
    ({"location": "  "}, ["location_not_blank"]),
    ({"component_category": None}, ["component_category_present"]),
    ({"component_category": "Anderes"}, ["component_category", "material_or_object"]),
    ({"material": "STB"}, ["material"]),
    ({"object_type": "Tür"}, ["material_or_object"]),
    ({"component_category": "Objekt", "material": None, "object_type": "Rohr"}, ["object_type"]),
    ({"price": -0.01}, ["price_not_negative"]),
    ({"quantity": 0.0}, ["quantity_positive"]),
    ({"quantity": None}, ["quantity_present"]),
    ({"unit": "kg"}, ["unit"]),
    ({"potential": "hoch"}, ["potential"]),
    ({"height": 0.0, "contact": " ", "name": ""}, ["contact_not_blank", "height_positive", "name_not_blank"]),
]


def test_market(spark):
    rows = spark.createDataFrame([tuple((PART | c | {"id": i}).values()) for i, (c, _) in enumerate(CASES)], MARKET)
    got = {r.id: sorted(r.violations) for r in rules.judged(rows, rules.market_rules()).collect()}
    assert got == {i: sorted(want) for i, (_, want) in enumerate(CASES)}
    assert sorted(r.id for r in rules.accepted(rows, rules.market_rules()).collect()) == [0, 1]
    assert {r.rule: r.n for r in rules.counted(rows, rules.market_rules()).collect()}["material_or_object"] == 2
    assert rules.accepted(rows.where("false"), rules.market_rules()).count() == 0
    with pytest.raises(ValueError):
        rules.judged(rows.withColumn("violations", F.lit(1)), rules.market_rules())


def test_parts_objects_buildings(spark):
    part = "id long, building_id string, user_building_id long, owner_id long, category string, name string, location string, part_type string, part_structure struct<type:string,layers:array<struct<material:string>>>, is_public boolean, is_hazardous boolean"
    sound = ("b", 1, 1, "Bauteil", "n", "KG", "Außenwand")
    structures = [("wall", [("Putz",)]), ("roof", [("Putz",)]), ("slab", []), (None, None), None]
    rows = spark.createDataFrame([(i, *sound, s, True, False) for i, s in enumerate(structures)] + [(5, "b", 1, 1, "Objekt", "n", " ", "Wand", structures[0], None, False)], part)
    got = {r.id: sorted(r.violations) for r in rules.judged(rows, rules.part_rules()).collect()}
    assert got == {0: [], 1: ["structure_type"], 2: ["structure_layers"], 3: ["structure_layers", "structure_type"], 4: ["part_structure_present"], 5: ["category", "is_public_present", "location_not_blank", "part_type"]}
    objects = spark.createDataFrame([(1, "b", 1, 1, "Objekt", "n", "Zarge", 1, None, True), (2, "b", 1, 1, "Objekt", "n", "", 0, -1.0, None)], "id long, building_id string, user_building_id long, owner_id long, category string, name string, object_type string, count int, length double, is_public boolean")
    objects = objects.withColumns({"width": F.lit(None).cast("double"), "height": F.lit(1.0), "is_hazardous": F.lit(False)})
    got = {r.id: sorted(r.violations) for r in rules.judged(objects, rules.object_rules()).collect()}
    assert got == {1: [], 2: ["count_positive", "is_public_present", "length_positive", "object_type", "object_type_not_blank"]}
    buildings = spark.createDataFrame([(1, "b", "s", "n", "a"), (1, "b", None, " ", "a"), (2, None, "s", "n", None), (2, None, "s", "n", "a")], "user_id long, building_id string, structure string, name string, address string")
    assert [sorted(r.violations) for r in rules.judged(buildings, rules.building_rules()).collect()] == [[], ["name_not_blank", "structure_present"], ["address_present", "building_id_present"], ["building_id_present"]]
    assert [tuple(r) for r in rules.repeated(buildings, "user_id", "building_id").collect()] == [(1, "b", 2)]
