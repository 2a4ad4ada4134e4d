"""Steps are dealt into tasks by their rows, not by the bytes of a small file, and no side of a join is sent whole."""

import pytest
from pyspark.sql import functions as F

from lithos.functions import numbers as nb
from lithos.functions import rings
from lithos.operators import footprints as fp
from lithos.operators import rules, spatial, structure
from lithos.plans import building_queries, footprint_queries, views

DIR = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_buildings_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(views, "BUILDINGS_A_TASK", 10)
    assert tasks(views.view(spark, DIR, "buildings")) >= 10


def test_layers_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES_A_TASK", 500)
    assert tasks(views.view(spark, DIR, "layers")) >= 10


def test_neighbours_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(spatial, "POINTS_A_TASK", 10)
    b = views.view(spark, DIR, "buildings").select("bw_geb_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    assert tasks(spatial.radius_pairs(b, 30.0, "bw_geb_id")) >= 8


def test_pairs_of_outlines_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(rings, "POLYGONS_A_TASK", 10)
    assert tasks(fp.outline_pairs(footprint_queries._boxes(spark, DIR), "bw_geb_id", 13.5)) >= 8


@pytest.mark.parametrize("pairs", [
    lambda s: fp.outline_pairs(footprint_queries._boxes(s, DIR), "bw_geb_id", 13.5),
    lambda s: spatial.neighbour_stats(views.view(s, DIR, "buildings"), 30.0),
    lambda s: rings.touching(building_queries._rings(s, DIR), "bw_geb_id"),
    lambda s: views.view(s, DIR, "layers").where("pos > 0"),
])
def test_pairs_are_merged_and_not_sent_whole(spark, capsys, pairs):
    pairs(spark).explain()
    assert "SortMergeJoin" in capsys.readouterr().out


def test_dissolving_sends_nothing_whole(spark, capsys):
    fp._met(spark.range(5).toDF("g"), spark.range(5).toDF("g"), ["g"], 3).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_slider_is_the_nearest_option_of_many(spark):
    options = [float(i * i) for i in range(700)]
    values = [v / 4 for v in range(-8, 4000, 3)] + [488601.0, 488601.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", nb.slider_index(F.col("v"), options).alias("i")).collect()
    for v, i in got:
        assert i == (700 if v > options[-1] else min(range(700), key=lambda k: (abs(v - options[k]), k)))
    with pytest.raises(ValueError):
        nb.slider_index(F.lit(1.0), [1.0, 1.0])


def test_accepted_rows_have_no_list_made(spark, capsys):
    """The conditions reach the tables below the joins."""
    rows = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, None)], "id int, price double")
    rows = rows.join(spark.range(4).toDF("id"), "id")
    only = {"price": F.col("price") >= 0, "id": F.col("id") < 9}
    assert sorted(r[0] for r in rules.accepted(rows, only).collect()) == [1, 3]
    assert sorted(r[0] for r in rows.where(F.size(structure.violations(only)) == 0).collect()) == [1, 3]
    rules.accepted(rows, only).explain()
    assert "filter(array" not in capsys.readouterr().out
