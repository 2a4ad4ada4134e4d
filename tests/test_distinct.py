"""Steps whose work grows with what is distinct, and the layers view as its SQL."""

import duckdb
from pyspark.sql import functions as F

from lithos.operators import markov as mk
from lithos.operators import thickness as th
from lithos.plans.views import VIEWS, view

DIR = "/root/testdata/sf0.001"


def test_layers_view_equals_its_sql(spark):
    con = duckdb.connect()
    for t in "lineitem orders customer part".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    columns = ["build_id", "pos", "bauperiode", "ort", "art", "nettoflaeche", "material", "thickness"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({VIEWS['layers']}) ORDER BY 1, 2").fetchall()
    assert [tuple(r) for r in view(spark, DIR, "layers").select(*columns).orderBy("build_id", "pos").collect()] == want


def test_equal_questions_are_scored_once(spark, monkeypatch):
    cat = spark.createDataFrame([("a", "b", "c", ["STB", "Putz"], 1.0), ("a", "b", "c", ["Putz", "STB"], 2.0)], "bauperiode string, ort string, art string, seq array<string>, w double")
    asked = spark.range(200).select(F.col("id").alias("req_id"), F.lit("a").alias("bauperiode"), F.lit("b").alias("ort"), F.lit("c").alias("art"), F.array(F.lit("Beton"), F.lit("Putz")).alias("seq"))
    seen, plain = [], mk.scores
    monkeypatch.setattr(mk, "scores", lambda seqs, *a: (seen.append(seqs.count()), plain(seqs, *a))[1])
    got = mk.translate(asked, mk.distributions(cat)).collect()
    assert len(got) == 200 and {tuple(r.seq) for r in got} == {("STB", "Putz")} and max(seen) < 10
    got = mk.check(asked, cat).collect()
    assert sorted(r.req_id for r in got) == list(range(200)) and {r.unknown for r in got} == {True} and max(seen) < 10


def test_leave_one_out_looks_levels_up_once(spark, monkeypatch):
    rows = [(i, "a", "b", "c", 1.0, p, m, 0.1 * i) for i in range(1, 41) for p, m in ((1, "STB"), (2, "Putz"))]
    layers = spark.createDataFrame(rows, "build_id long, bauperiode string, ort string, art string, nettoflaeche double, pos int, material string, thickness double")
    seen, plain = [], th.backoff
    monkeypatch.setattr(th, "backoff", lambda asked, *a: (seen.append(asked.count()), plain(asked, *a))[1])
    got = {(r.build_id, r.pos): r.seq_mean for r in th.leave_one_out(layers).collect()}
    assert seen == [2] and len(got) == 80 and abs(got[1, 1] - 0.1 * (820 - 1) / 39) < 1e-9
