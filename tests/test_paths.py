"""Readings and scores along steps, against all readings multiplied out."""

import itertools
import json
import math
import random

from pyspark.sql import functions as F

from lithos.operators import markov as mk
from lithos.operators import paths, plausibility

OPTIONS = {"x": ["a", "b", "c"], "y": ["b", "a"], "z": ["z", "c"]}
CATALOG = "bauperiode string, ort string, art string, seq array<string>, w double"


def test_best_reading_is_that_of_all():
    """Few different logarithms, so that many readings tie."""
    r = random.Random(5)
    for _ in range(400):
        words = ["^", "a", "b", "c", "z", "$"]
        steps = {s: r.choice([None, -1, -2, -2, -3]) for s in itertools.product(words, repeat=3)}
        seq = [r.choice("xyza") for _ in range(r.randint(0, 5))]
        best, top = None, -math.inf
        for v in itertools.product(*[OPTIONS.get(m, [m]) for m in seq]):
            totals = [t for t in (paths.total_log(list(w), steps) for w in (v, v[::-1])) if t is not None]
            if best is None or max(totals, default=-math.inf) > top:
                best, top = list(v), max(totals, default=-math.inf)
        assert paths.best_reading(seq, OPTIONS, steps) == best, seq


def test_many_readings_are_not_multiplied_out(spark):
    """3 ** 40 readings of one build-up; a cell that is null, and an empty build-up."""
    cat = spark.createDataFrame([("a", "b", "c", ["Beton", "Beton", "Betonfertigteil"], 5.0), ("a", "b", "c", ["Beton"] * 3 + ["Putz"], 1.0)], CATALOG)
    rows = [(1, "a", "b", "c", ["Beton"] * 40 + ["Putz"]), (2, None, "b", "c", ["Beton", "Putz"]), (3, "a", "b", "c", []), (4, "a", "b", "c", ["Putz"] + ["Beton"] * 3), (5, "a", "b", "c", None)]
    asked = spark.createDataFrame(rows, "req_id int, bauperiode string, ort string, art string, seq array<string>")
    got = {r.req_id: r.seq for r in mk.translate(asked, mk.distributions(cat)).collect()}
    assert got == {1: ["Beton"] * 40 + ["Putz"], 2: ["STB", "Putz"], 3: [], 4: ["Putz"] + ["Beton"] * 3}


def test_nothing_of_the_questions_is_broadcast(spark, capsys, monkeypatch):
    """Build-ups are dealt into tasks by their number, and joined by merges."""
    monkeypatch.setattr(paths, "QUESTIONS_A_TASK", 10)
    cat = spark.createDataFrame([("a", "b", "c", [f"m{i}", "STB"], 1.0) for i in range(200)], CATALOG)
    asked = spark.range(200).select(F.col("id").alias("req_id"), F.lit("a").alias("bauperiode"), F.lit("b").alias("ort"), F.lit("c").alias("art"), F.array(F.concat(F.lit("m"), F.col("id")), F.lit("Beton")).alias("seq"))
    read = mk.translate(asked, mk.distributions(cat))
    read.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" not in plan.split("FlatMapCoGroupsInArrow")[0] and plan.count("SortMergeJoin") >= 2
    assert {r.req_id: r.seq for r in read.collect()} == {i: [f"m{i}", "STB"] for i in range(200)}
    got = mk.check(asked.withColumn("seq", F.array(F.get("seq", 0), F.lit("STB"))), cat)
    assert {(r.tier, r.unknown) for r in got.collect()} == {(3, False)}


def test_mean_of_logarithms_is_that_of_decimals(spark):
    r = random.Random(1)
    rows = [(i, -r.randint(0, 10**15)) for i in range(60) for _ in range(i % 9 + 1)]
    df = spark.createDataFrame(rows, "k int, x long").withColumn("d", (F.col("x").cast("decimal(30,14)") / F.lit(paths.UNIT)).cast("decimal(18,14)"))
    want = {x.k: (x.m, x.s, x.n) for x in df.groupBy("k").agg(F.avg("d").cast("double").alias("m"), F.sum("x").alias("s"), F.count("x").alias("n")).collect()}
    assert len(want) == 60 and all(paths.mean_log(s, n) == m for m, s, n in want.values())


def test_answers_are_merged_and_readings_not_multiplied_out(spark, capsys):
    cat = spark.createDataFrame([("1980-1999", "RG", "AW", ["STB", "STB", "Putz"], 5.0), ("1980-1999", "RG", "AW", ["Putz", "Beton"], 1.0)], CATALOG)
    body = json.dumps({"period": "1980-1999", "floor_type": "RG", "part_type": "AW", "materials": ["Beton"] * 30 + ["Putz"]})
    got = plausibility.answers(spark.createDataFrame([(1, body), (2, body), (3, "{")], "id int, body string"), cat)
    got.explain()
    joins = [x for x in capsys.readouterr().out.splitlines() if "BroadcastHashJoin" in x]
    assert not [x for x in joins if "req_id" in x or "_same" in x]
    got = {r.id: r for r in got.collect()}
    assert got[1].gelesen_als == got[2].gelesen_als == ["STB"] * 30 + ["Putz"] and got[1].stufe == 1 and got[3].error
