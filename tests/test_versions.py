"""Versioned tables: whole commits, conflicts, and the replacement of extracts."""

import pytest
from pyspark.sql import functions as F

from lithos.sources import versions as vs

PARTS = "source_extract_id string, name string, location string"
OBJECTS = "source_extract_id string, name string, object_type string"
def rules():
    return {"objects": {"object_type": F.col("object_type").isin("Tür", "Fenster")}}


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def plan(spark, extract, n_parts, n_objects, kind="Tür"):
    return {"parts": rows(spark, PARTS, *[(extract, f"p{i}", "RG 1") for i in range(n_parts)]), "objects": rows(spark, OBJECTS, *[(extract, f"o{i}", kind) for i in range(n_objects)])}


def names(spark, path, table):
    return sorted((r.source_extract_id or "-", r.name) for r in vs.read(spark, path, table, vs.latest(spark, path)).collect())


def test_reallocation(spark, tmp_path):
    path = f"file://{tmp_path}/hub"
    by_hand = {"parts": rows(spark, PARTS, (None, "hand", "KG")), "objects": rows(spark, OBJECTS, (None, "hand", "Tür"))}
    assert vs.latest(spark, path) is None and vs.commit(spark, path, by_hand, None) == 1
    load = lambda p: tuple(vs.import_extracts(spark, path, p, rules()).first())
    assert load(plan(spark, "a", 2, 1)) == ("a", 0, 2, 0, 1)
    assert load(plan(spark, "a", 2, 1)) == ("a", 2, 2, 1, 1)  # again: not doubled
    assert load(plan(spark, "b", 1, 0)) == ("b", 0, 1, 0, 0)
    assert load(plan(spark, "a", 1, 0)) == ("a", 2, 1, 1, 0)  # a storey left out leaves nothing behind
    assert names(spark, path, "parts") == [("-", "hand"), ("a", "p0"), ("b", "p0")] and names(spark, path, "objects") == [("-", "hand")]
    for wrong, what in ((plan(spark, "c", 0, 0), "nothing"), (plan(spark, "a", 1, 2, "Tor"), "objects.object_type: 2"), (plan(spark, None, 1, 0), "parts.source_extract_id: 1")):
        with pytest.raises(vs.Rejected, match=what):
            vs.import_extracts(spark, path, wrong, rules())
    assert vs.latest(spark, path) == 5 and len(names(spark, path, "parts")) == 3
    vs.vacuum(spark, path, 1)
    assert vs.versions(spark, path) == [5] and len(names(spark, path, "parts")) == 3


def test_first_import_into_nothing(spark, tmp_path):
    got = vs.import_extracts(spark, f"file://{tmp_path}/new", plan(spark, "a", 1, 1), rules())
    assert tuple(got.first()) == ("a", 0, 1, 0, 1)


def test_two_writers(spark, tmp_path):
    """The second writer on one base changes nothing; an import that meets another one keeps both."""
    path = f"file://{tmp_path}/hub"
    vs.commit(spark, path, plan(spark, "a", 1, 1), None)
    vs.commit(spark, path, plan(spark, "b", 1, 1), 1)
    with pytest.raises(vs.Conflict):
        vs.commit(spark, path, plan(spark, "c", 1, 1), 1)
    assert {x for x, _ in names(spark, path, "parts")} == {"b"} and not [p for p in (tmp_path / "hub").iterdir() if p.name.startswith("_")]
    met = []

    def change(base):
        old = vs.read(spark, path, "parts", base)
        if not met:  # another writer is faster the first time
            met.append(base)
            vs.commit(spark, path, {"parts": old.unionByName(plan(spark, "d", 1, 0)["parts"])}, base)
        return {"parts": old.unionByName(plan(spark, "e", 1, 0)["parts"])}

    assert vs.updated(spark, path, change) == 4 and met == [2]
    assert {x for x, _ in names(spark, path, "parts")} == {"b", "d", "e"}


def test_failed_write_leaves_the_old(spark, tmp_path):
    path = f"file://{tmp_path}/hub"
    vs.commit(spark, path, plan(spark, "a", 1, 1), None)
    bad = plan(spark, "b", 1, 1)
    bad["objects"] = bad["objects"].withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        vs.commit(spark, path, bad, 1)
    assert vs.versions(spark, path) == [1] and [p.name for p in (tmp_path / "hub").iterdir()] == ["v1"]
