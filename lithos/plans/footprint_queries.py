"""Queries over footprints as rings and over the period model built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import periods, rings
from lithos.operators import footprints as fp
from lithos.operators import period_model as pm
from lithos.plans.views import view, with_views

#: No distance of the footprints' steps lies on it.
RADIUS = 13.5
TYPES = ["nach 1945", "1919 - 1945", "vor 1848", "1848-1918", "unbekannt"]


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _boxes(spark, d):
    b = view(spark, d, "buildings")
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("wx"), F.col("y0") + F.col("wy")
    return b.withColumn("ring", F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1), _point(x0, y0)))


def _corners(spark, d):
    """Footprints without their upper right quarter."""
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("wx"), F.col("y0") + F.col("wy")
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(_point(x0, y0), _point(x1, y0), _point(x1, ym), _point(xm, ym), _point(xm, y1), _point(x0, y1), _point(x0, y0))
    return view(spark, d, "buildings").withColumn("ring", ring)


def _typed(rows):
    return rows.withColumn("typology", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("bw_geb_id") % len(TYPES) + 1).cast("int")))


def _vectors(spark, d):
    rows = fp.period_features(_corners(spark, d), fp.surroundings(_boxes(spark, d), "bw_geb_id", RADIUS), "bw_geb_id")
    b = _typed(view(spark, d, "buildings")).select("bw_geb_id", "dom_nutzung", "bp_best_guess", "typology", "x0", "y0")
    return pm.vectors(pm.known(rows.join(b, "bw_geb_id"), "bp_best_guess", "typology"), "dom_nutzung")


def q_dissolved(spark, d):
    block = (F.floor(F.col("bw_geb_id") / 1000) * 10 + F.floor(F.col("bw_geb_id") % 100 / 10)).cast("long")
    rows = fp.dissolved(_boxes(spark, d).withColumn("block", block), "block", "bp_best_guess", "maxhoehe")
    return rows.select("block", "bp_code", F.round("height_m", 6).alias("height_m"), F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"))


def q_hulls(spark, d):
    h = F.col("hull")
    rows = _corners(spark, d).withColumn("hull", fp.hull(F.col("ring")))
    return rows.select("bw_geb_id", F.round(rings.area(h), 6).alias("hull_area"), F.size(h).alias("n_vertices"), F.round(rings.perimeter(h), 6).alias("hull_perimeter"))


def q_outline_neighbours(spark, d):
    rows = fp.surroundings(_boxes(spark, d), "bw_geb_id", RADIUS)
    return rows.select("bw_geb_id", "n_nb", *[F.round(c, 6).alias(c) for c in ("sum_nb_area", "mean_nb_area", "std_nb_area")])


def q_features(spark, d):
    rows = fp.period_features(_corners(spark, d), fp.surroundings(_boxes(spark, d), "bw_geb_id", RADIUS), "bw_geb_id")
    return rows.select("bw_geb_id", *[F.round(c, 7).alias(c) for c in fp.FEATURES])


def q_known(spark, d):
    return pm.known(_typed(view(spark, d, "buildings")), "bp_best_guess", "typology").select("bw_geb_id", "k5", "k3")


def q_late_shares(spark, d):
    """Shares of the late classes from given probabilities."""
    rows = view(spark, d, "buildings").select("bw_geb_id", (F.col("bw_geb_id") % 97 / 97).alias("late"), F.array(F.lit(0.5), F.col("dom_nutzung") / 8, F.lit(0.125)).alias("fine"))
    return pm.late_shares(rows, F.col("late"), F.col("fine")).select("bw_geb_id", *[f"p_bp{c}" for c in pm.LATE])


def q_folds(spark, d):
    return view(spark, d, "buildings").select("bw_geb_id", pm.spatial_fold(F.col("x0"), F.col("y0"), 70.0).alias("fold"))


def q_overall(spark, d):
    b = view(spark, d, "buildings").select(periods.collapse_bp(F.col("bp")).alias("truth"), F.col("bp_best_guess").alias("predicted")).where("truth > 0")
    return pm.overall(b).select("n", F.round("accuracy", 8).alias("accuracy"), F.round("balanced_accuracy", 8).alias("balanced_accuracy"))


def q_two_stage(spark, d):
    return pm.two_stage(_vectors(spark, d), "bw_geb_id", trees=30, depth=8)


def q_spatial_cv(spark, d):
    rows = _vectors(spark, d).withColumn("fold", pm.spatial_fold(F.col("x0"), F.col("y0"), 70.0))
    return pm.overall(pm.cross_validated(rows, pm.coarse_label(), len(pm.COARSE), trees=15, depth=6))


QUERIES = {
    "dissolved_footprints": q_dissolved, "footprint_hulls": q_hulls, "outline_neighbours": q_outline_neighbours, "period_feature_table": q_features,
    "known_periods": q_known, "late_period_shares": q_late_shares, "spatial_folds": q_folds, "overall_accuracy": q_overall,
    "two_stage_period": q_two_stage, "spatial_cross_validation": q_spatial_cv,
}

_NEAR = f"""near AS (SELECT a.bw_geb_id, o.wx * o.wy AS area FROM buildings a JOIN buildings o ON a.bw_geb_id <> o.bw_geb_id
  AND power(greatest(0, o.x0 - a.x0 - a.wx, a.x0 - o.x0 - o.wx), 2) + power(greatest(0, o.y0 - a.y0 - a.wy, a.y0 - o.y0 - o.wy), 2) <= {RADIUS * RADIUS}),
ctx AS (SELECT bw_geb_id, count(*) AS n_nb, sum(area) AS sum_nb_area, avg(area) AS mean_nb_area, stddev_samp(area) AS std_nb_area FROM near GROUP BY 1)"""
_A, _P = "(0.75 * wx * wy)", "(2 * (wx + wy))"
_TYPE = f"({TYPES})[bw_geb_id % {len(TYPES)} + 1]"
_V = {
    "dissolved_footprints": """
WITH r AS (SELECT *, floor(bw_geb_id / 1000)::BIGINT * 10 + floor(bw_geb_id % 100 / 10)::BIGINT AS block FROM buildings),
s AS (SELECT a.block, sum(greatest(0, least(a.x0 + a.wx, o.x0 + o.wx) - greatest(a.x0, o.x0)) * ((a.y0 + a.wy = o.y0)::INT + (o.y0 + o.wy = a.y0)::INT)
   + greatest(0, least(a.y0 + a.wy, o.y0 + o.wy) - greatest(a.y0, o.y0)) * ((a.x0 + a.wx = o.x0)::INT + (o.x0 + o.wx = a.x0)::INT)) AS shared
  FROM r a JOIN r o ON a.block = o.block AND a.bw_geb_id < o.bw_geb_id GROUP BY 1),
m AS (SELECT block, bp_best_guess, row_number() OVER (PARTITION BY block ORDER BY count(*) DESC, bp_best_guess) AS rn FROM r GROUP BY 1, 2)
SELECT r.block, any_value(m.bp_best_guess)::INT AS bp_code, round(max(maxhoehe), 6) AS height_m, round(sum(wx * wy), 4) AS area, round(sum(2 * (wx + wy)) - 2 * coalesce(any_value(shared), 0), 4) AS perimeter
FROM r JOIN m ON r.block = m.block AND rn = 1 LEFT JOIN s ON r.block = s.block GROUP BY r.block""",
    "footprint_hulls": "SELECT bw_geb_id, round(wx * wy * 7 / 8, 6) AS hull_area, 6 AS n_vertices, round(1.5 * (wx + wy) + sqrt(wx * wx + wy * wy) / 2, 6) AS hull_perimeter FROM buildings",
    "outline_neighbours": f"WITH {_NEAR} SELECT b.bw_geb_id, coalesce(n_nb, 0) AS n_nb, round(coalesce(sum_nb_area, 0), 6) AS sum_nb_area, round(mean_nb_area, 6) AS mean_nb_area, round(std_nb_area, 6) AS std_nb_area FROM buildings b LEFT JOIN ctx USING (bw_geb_id)",
    "period_feature_table": f"""
WITH {_NEAR}
SELECT bw_geb_id, round(ln({_A}), 7) AS log_area, round(ln(greatest(m3vol, 1)), 7) AS log_vol, round(greatest(m3vol, 0) / {_A}, 7) AS vol_per_area, round(m2bgf, 7) AS m2bgf, round(maxhoehe, 7) AS maxhoehe,
  {_P} AS perim_m, 7.0::DOUBLE AS npoints, round(4 * pi() * {_A} / ({_P} * {_P}), 7) AS compactness, round({_P} / sqrt({_A}), 7) AS shape_idx, round(6 / 7::DOUBLE, 7) AS solidity,
  coalesce(n_nb, 0)::DOUBLE AS n_nb, round(ln(greatest(coalesce(mean_nb_area, 0), 1)), 7) AS log_mean_area, round(coalesce(std_nb_area, 0), 7) AS std_nb_area, round(least(3, coalesce(sum_nb_area, 0) / 37000), 7) AS builtfrac
FROM buildings LEFT JOIN ctx USING (bw_geb_id)""",
    "known_periods": f"""
WITH t AS (SELECT bw_geb_id, CASE WHEN bp_best_guess > 0 THEN bp_best_guess END::INT AS k5, replace({_TYPE}, ' ', '') AS s FROM buildings)
SELECT bw_geb_id, k5, CASE WHEN k5 = 1 THEN 'bis 1918' WHEN k5 = 2 THEN '1919-1945' WHEN k5 >= 3 OR s = 'nach1945' THEN 'nach 1945' WHEN s LIKE '1919%' THEN '1919-1945' WHEN s IN ('vor1848', '1848-1918', '1849-1859') THEN 'bis 1918' END AS k3 FROM t""",
    "late_period_shares": "SELECT bw_geb_id, round_even(bw_geb_id % 97 / 97 * 0.5::DOUBLE, 3) AS p_bp3, round_even(bw_geb_id % 97 / 97 * (dom_nutzung / 8), 3) AS p_bp4, round_even(bw_geb_id % 97 / 97 * 0.125::DOUBLE, 3) AS p_bp5 FROM buildings",
    "spatial_folds": "SELECT bw_geb_id, ('0x' || substr(md5(round_even(x0 / 70, 0)::BIGINT || '_' || round_even(y0 / 70, 0)::BIGINT), 1, 8))::BIGINT % 5 AS fold FROM buildings",
    "overall_accuracy": """
WITH t AS (SELECT coalesce(list_min(list_filter(list_transform(string_split(bp, ','), lambda t: t::INT), lambda c: c <> 0)), 0) AS truth, bp_best_guess AS predicted FROM buildings),
c AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = predicted) AS hit FROM t WHERE truth > 0 GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 8) AS accuracy, round(avg(hit / n), 8) AS balanced_accuracy FROM c""",
}
ORACLES = {k: with_views(v, "buildings") for k, v in _V.items()}
