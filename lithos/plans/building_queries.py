"""Queries of buildings: periods, geometry, balance, period prediction, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import periods
from lithos.functions import rings as rg
from lithos.operators import markov as mk
from lithos.operators import parametric as pm
from lithos.operators import spatial as sp
from lithos.operators import thickness as th
from lithos.plans.views import view, with_views
from lithos.vocab import DENSITY, DENSITY_DEFAULT, IW_LAYERS, IW_LFM, OPEN_AW, OPEN_IW, PERIOD_METRICS, PERIODS


def _b(spark, d):
    return view(spark, d, "buildings")


def q_collapse(spark, d):
    return _b(spark, d).select("bw_geb_id", periods.collapse_bp(F.col("bp")).alias("bp_code"))


def q_label(spark, d):
    return _b(spark, d).select("bw_geb_id", periods.label_or_list(F.when(F.col("dom_nutzung") != 2, F.col("bp_best_guess")), F.col("bp")).alias("period"))


def q_usage_period(spark, d):
    return _b(spark, d).where(F.col("dom_nutzung").isin(1, 3) & periods.has_period(F.col("bp"), [1, 4])).select("bw_geb_id", "dom_nutzung", "bp")


def q_parametric(spark, d):
    return pm.parametric(_b(spark, d))


def q_elements(spark, d):
    return pm.elements(pm.parametric(_b(spark, d))).groupBy("bauperiode", "ort", "art").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area"))


def q_interior(spark, d):
    return pm.interior(pm.parametric(_b(spark, d))).groupBy("bauperiode", "kind", "material").agg(F.round(F.sum(F.col("area") * F.col("thickness")), 4).alias("volume"))


def _facts(spark, d):
    facts = pm.parametric(_b(spark, d))
    return pm.balance(facts, pm.profiles(facts, view(spark, d, "layers")))


#: Build-ups (material, thickness in m) by kind of element, for the roll-ups that SQL can follow.
FIXED_PROFILE = {"AW": [("Putz", 0.02), ("Ziegel", 0.4), ("Styropor", 0.1)], "FB": [("Estrich", 0.06), ("STB", 0.2)], "D": [("Holz", 0.16), ("Folie", 0.001)]}


def q_balance_fixed(spark, d):
    """Volume and mass by period, element and material over given build-ups."""
    rows = [(p, o, k, m, t) for p in PERIODS.values() for o in ("KG", "RG", "DG") for k, v in FIXED_PROFILE.items() for m, t in v]
    names = ("bauperiode", "ort", "art", "material", "thickness")
    profiles = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])))
    facts = pm.balance(pm.parametric(_b(spark, d)), profiles)
    return facts.groupBy("bauperiode", "element", "material").agg(F.round(F.sum("volume"), 3).alias("volume"), F.round(F.sum("mass"), 1).alias("mass"))


def q_volume(spark, d):
    return _facts(spark, d).groupBy("material").agg(F.round(F.sum("volume"), 3).alias("volume"), F.round(F.sum("mass"), 1).alias("mass"))


def q_mass_by(spark, d):
    sets = _facts(spark, d).groupingSets([["bauperiode"], ["element"]], "bauperiode", "element").agg(F.sum("mass").alias("mass"))
    return sets.select(F.coalesce("bauperiode", F.lit("-")).alias("bauperiode"), F.coalesce("element", F.lit("-")).alias("element"), F.round("mass", 1).alias("mass"))


def q_default_share(spark, d):
    known = F.col("material").isin(*DENSITY)
    return _facts(spark, d).agg(F.round(F.sum(F.when(known, 0.0).otherwise(F.col("mass"))) / F.sum("mass"), 8).alias("default_share"))


def q_neighbours(spark, d):
    return sp.neighbour_stats(_b(spark, d), 30.0)


def q_point_in_polygon(spark, d):
    """Points of events laid over the city, with the footprint that holds each."""
    pts = view(spark, d, "jobs").select(F.col("event_id").alias("pt"), (F.col("value") * 2.4).alias("x"), (F.col("job_id") % 160).cast("double").alias("y"))
    return sp.within_rectangles(pts, _b(spark, d))


def q_features(spark, d):
    b = _b(spark, d)
    area, perim = F.col("wx") * F.col("wy"), 2 * (F.col("wx") + F.col("wy"))
    return b.select("bw_geb_id", F.round(4 * F.pi() * area / (perim * perim), 8).alias("compactness"), F.round(F.ln(area), 8).alias("log_area"), F.round(F.ln(F.greatest(F.col("m3vol"), F.lit(1.0))), 8).alias("log_vol"), F.round(perim / F.sqrt(area), 8).alias("shape_idx"), F.round(F.greatest(F.col("m3vol"), F.lit(0.0)) / area, 6).alias("vol_per_area"))


def q_assemble(spark, d):
    """Final period from known fine, known coarse and predicted classes, with given probabilities."""
    b = _b(spark, d).withColumns({"k5": F.when(F.col("bp_best_guess").between(1, 5), F.col("bp_best_guess")), "k3": F.when(F.col("bw_geb_id") % 5 == 0, F.element_at(F.array(F.lit("bis 1918"), F.lit("1919-1945"), F.lit("nach 1945")), (F.col("bw_geb_id") % 3 + 1).cast("int"))), "p1": (F.col("bw_geb_id") % 60 + 40) / 100, "p2": (F.col("bw_geb_id") % 50 + 50) / 100, "s1": F.element_at(F.array(F.lit("bis 1918"), F.lit("1919-1945"), F.lit("nach 1945")), (F.col("dom_nutzung") % 3 + 1).cast("int")), "s2": F.col("dom_nutzung") % 3 + 3})
    return sp.assemble_period(b).select("bw_geb_id", "bp5", "coarse3", "source", "conf")


def q_accuracy(spark, d):
    b = _b(spark, d).select(periods.collapse_bp(F.col("bp")).alias("truth"), F.col("bp_best_guess").alias("predicted")).where("truth > 0")
    return sp.class_metrics(b)


def q_pivot(spark, d):
    b = _b(spark, d).select("bw_geb_id", F.col("m2bgf").alias("wohnen"), (F.col("m2bgf") - 5000).alias("buero"), (F.col("m3vol") - 20000).alias("handel"), F.lit(0.0).alias("industrie"))
    return b.unpivot("bw_geb_id", ["wohnen", "buero", "handel", "industrie"], "usage", "area").where("area > 0").select("bw_geb_id", "usage", F.round("area", 2).alias("area"))


def _rings(spark, d):
    """Footprints with a gable over the upper side: a ring that is not a rectangle."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("wx"), F.col("y0") + F.col("wy")
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point((x0 + x1) / 2, y1 + 3), point(x0, y1), point(x0, y0))
    return _b(spark, d).select("bw_geb_id", ring.alias("ring"))


def q_rings(spark, d):
    r = F.col("ring")
    return _rings(spark, d).select("bw_geb_id", F.round(rg.area(r), 6).alias("area"), F.round(rg.perimeter(r), 6).alias("perimeter"), F.size(r).alias("n_vertices"), F.round(rg.centroid(r)["x"], 6).alias("cx"), F.round(rg.centroid(r)["y"], 6).alias("cy"), F.round(rg.inset_area(r, F.lit(0.35)), 6).alias("net"))


def q_ring_contains(spark, d):
    pts = view(spark, d, "jobs").select(F.col("event_id").alias("pt"), (F.col("value") * 2.4).alias("x"), (F.col("job_id") % 160).cast("double").alias("y"))
    return rg.within(pts, _rings(spark, d), "pt", "bw_geb_id")


def q_ring_touching(spark, d):
    return rg.touching(_rings(spark, d), "bw_geb_id").select("bw_geb_id", F.round("touching", 4).alias("touching"))


def q_forest(spark, d):
    return sp.predict_period(_b(spark, d))


def _m(name):
    t, fb = PERIOD_METRICS[name]
    return f"CASE bp_code {' '.join(f'WHEN {k} THEN {v}' for k, v in t.items())} ELSE {fb} END" if t else str(fb)


def _c(t, fb):
    return f"(CASE bp_code {' '.join(f'WHEN {k} THEN {v}' for k, v in t.items())} ELSE {fb} END)::DOUBLE"


CODE = "coalesce(list_min(list_filter(list_transform(string_split(bp, ','), lambda t: t::INT), lambda c: c <> 0)), 0)"
PARA = f"""b AS (SELECT *, {CODE} AS bp_code FROM buildings),
t AS (SELECT a.bw_geb_id, sum(greatest(0, least(a.x0 + a.wx, o.x0 + o.wx) - greatest(a.x0, o.x0)) * ((a.y0 = o.y0)::INT + (a.y0 = o.y0 + o.wy)::INT + (a.y0 + a.wy = o.y0)::INT + (a.y0 + a.wy = o.y0 + o.wy)::INT)
   + greatest(0, least(a.y0 + a.wy, o.y0 + o.wy) - greatest(a.y0, o.y0)) * ((a.x0 = o.x0)::INT + (a.x0 = o.x0 + o.wx)::INT + (a.x0 + a.wx = o.x0)::INT + (a.x0 + a.wx = o.x0 + o.wx)::INT)) AS touching
  FROM buildings a JOIN buildings o ON a.bw_geb_id <> o.bw_geb_id AND a.x0 <= o.x0 + o.wx AND o.x0 <= a.x0 + a.wx AND a.y0 <= o.y0 + o.wy AND o.y0 <= a.y0 + a.wy GROUP BY 1),
g AS (SELECT b.*, ({_m('wall_thickness_m')})::DOUBLE AS wt, wx * wy AS gross, 2 * (wx + wy) AS perim, least(coalesce(touching, 0), 2 * (wx + wy)) AS touch,
  CASE WHEN maxhoehe = 0 THEN 1 ELSE greatest(1, round_even(maxhoehe / ({_m('storey_height_m')})::DOUBLE, 0)::INT) END AS storeys FROM b LEFT JOIN t ON b.bw_geb_id = t.bw_geb_id),
n AS (SELECT *, greatest(0, wx - 2 * wt) * greatest(0, wy - 2 * wt) AS net FROM g),
para AS (SELECT bw_geb_id, bp_code, CASE bp_code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in PERIODS.items())} END AS bauperiode, storeys, 1 AS keller, least(1, storeys) AS dach, round_even(maxhoehe, 2) AS height_m, wt AS wall_thickness_m,
  round_even(gross, 2) AS gross_area_m2, round_even(net, 2) AS net_area_m2, round_even(1 - net / gross, 4) AS percentage_wall, round_even(perim - touch, 2) AS free_m, round_even(touch, 2) AS touching_m,
  round_even(({_m('interior_wall_lfm_per_m2')})::DOUBLE * net, 2) AS interior_m, round_even(gross * storeys, 2) AS floor_area_m2, round_even(gross * 1.2::DOUBLE, 2) AS roof_area_m2, round_even(greatest(wx, wy), 2) AS length_m FROM n)"""
ELEM = f"""fl AS (SELECT para.*, height_m / storeys AS h, ort, CASE ort WHEN 'KG' THEN keller WHEN 'RG' THEN greatest(0, storeys - dach) ELSE dach END AS k FROM para, (VALUES ('KG'), ('RG'), ('DG')) AS v(ort)),
el AS (SELECT bw_geb_id, bauperiode, ort, 'AW' AS art, (free_m + 0.5 * touching_m) * h * k * (1 - {_c(OPEN_AW, 0.25)}) AS area FROM fl WHERE k > 0
  UNION ALL SELECT bw_geb_id, bauperiode, ort, 'FB', gross_area_m2 * k FROM fl WHERE k > 0 UNION ALL SELECT bw_geb_id, bauperiode, 'DG', 'D', roof_area_m2 FROM para)"""
IWL = ", ".join(f"('{k}', {c}, '{m}', {t})" for k, by in IW_LAYERS.items() for c, v in by.items() for m, t in v)
IW = f"""lay(kind, code, material, thickness) AS (VALUES {IWL}),
w AS (SELECT bw_geb_id, bauperiode, bp_code, height_m / storeys * (keller + greatest(0, storeys - dach) + dach) AS hn, {_c(IW_LFM['tragend'], 0.12)} * net_area_m2 AS tr, {_c(IW_LFM['leicht'], 0.3)} * net_area_m2 AS le, length_m, 1 - {_c(OPEN_IW['tragend'], 0.08)} AS ot, 1 - {_c(OPEN_IW['leicht'], 0.2)} AS ol FROM para),
iw AS (SELECT bauperiode, kind, material, thickness::DOUBLE AS thickness, CASE kind WHEN 'tragend' THEN least(length_m, tr) * hn * ot WHEN 'wohnung' THEN greatest(0, tr - least(length_m, tr)) * hn * ot ELSE le * hn * ol END AS area FROM w JOIN lay ON code = bp_code)"""

QUERIES = {
    "collapse_bp": q_collapse,
    "period_label": q_label,
    "usage_period_filter": q_usage_period,
    "parametric_geometry": q_parametric,
    "element_areas": q_elements,
    "interior_walls": q_interior,
    "material_balance": q_volume,
    "mass_by_period_and_element": q_mass_by,
    "default_density_share": q_default_share,
    "balance_of_given_profiles": q_balance_fixed,
    "footprint_geometry": q_rings,
    "footprint_contains": q_ring_contains,
    "footprint_touching": q_ring_touching,
    "neighbour_stats": q_neighbours,
    "point_in_polygon": q_point_in_polygon,
    "period_features": q_features,
    "period_assembly": q_assemble,
    "period_accuracy": q_accuracy,
    "positive_usage_pivot": q_pivot,
    "period_forest": q_forest,
}

_LABEL = "CASE {} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PERIODS.items()) + " ELSE 'unbekannt' END"
_SQL = {
    "collapse_bp": f"SELECT bw_geb_id, {CODE} AS bp_code FROM buildings",
    "period_label": f"""SELECT bw_geb_id, CASE WHEN dom_nutzung <> 2 THEN {_LABEL.format("bp_best_guess")}
        ELSE array_to_string(list_transform(string_split(bp, ','), lambda t: {_LABEL.format("t::INT")}), ', ') END AS period FROM buildings""",
    "usage_period_filter": "SELECT bw_geb_id, dom_nutzung, bp FROM buildings WHERE dom_nutzung IN (1, 3) AND list_has_any(string_split(bp, ','), ['1', '4'])",
    "parametric_geometry": f"WITH {PARA} SELECT * FROM para",
    "element_areas": f"WITH {PARA}, {ELEM} SELECT bauperiode, ort, art, count(*) AS n, round(sum(area), 3) AS area FROM el WHERE area > 0 GROUP BY ALL",
    "interior_walls": f"WITH {PARA}, {IW} SELECT bauperiode, kind, material, round(sum(area * thickness), 4) AS volume FROM iw WHERE area > 0 GROUP BY ALL",
    "neighbour_stats": """WITH c AS (SELECT bw_geb_id, x0 + wx / 2 AS x, y0 + wy / 2 AS y, wx * wy AS area FROM buildings)
SELECT a.bw_geb_id, count(*) AS n_nb, round(sum(o.area), 6) AS sum_area, round(avg(o.area), 6) AS mean_area, round(stddev_samp(o.area), 6) AS std_area FROM c a JOIN c o ON a.bw_geb_id <> o.bw_geb_id AND (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= 900 GROUP BY 1""",
    "period_features": "SELECT bw_geb_id, round(4 * pi() * (wx * wy) / ((2 * (wx + wy)) * (2 * (wx + wy))), 8) AS compactness, round(ln(wx * wy), 8) AS log_area, round(ln(greatest(m3vol, 1)), 8) AS log_vol, round(2 * (wx + wy) / sqrt(wx * wy), 8) AS shape_idx, round(greatest(m3vol, 0) / (wx * wy), 6) AS vol_per_area FROM buildings",
    "positive_usage_pivot": "SELECT bw_geb_id, usage, round(area, 2) AS area FROM (SELECT bw_geb_id, unnest(['wohnen', 'buero', 'handel']) AS usage, unnest([m2bgf, m2bgf - 5000, m3vol - 20000]) AS area FROM buildings) WHERE area > 0",
    "period_accuracy": f"""WITH x AS (SELECT {CODE} AS truth, bp_best_guess AS predicted FROM buildings), y AS (SELECT * FROM x WHERE truth > 0),
k AS (SELECT DISTINCT truth AS class FROM y UNION SELECT DISTINCT predicted FROM y)
SELECT class, count(*) FILTER (truth = class) AS n, round(coalesce(2 * count(*) FILTER (truth = class AND predicted = class) / nullif(count(*) FILTER (truth = class) + count(*) FILTER (predicted = class), 0), 0), 8) AS f1, round(count(*) FILTER (truth = class AND predicted = class) / nullif(count(*) FILTER (truth = class), 0), 8) AS recall FROM k, y GROUP BY class""",
    "period_assembly": """WITH b AS (SELECT *, CASE WHEN bp_best_guess BETWEEN 1 AND 5 THEN bp_best_guess END AS k5, CASE WHEN bw_geb_id % 5 = 0 THEN (['bis 1918', '1919-1945', 'nach 1945'])[(bw_geb_id % 3 + 1)::INT] END AS k3,
(bw_geb_id % 60 + 40) / 100 AS p1, (bw_geb_id % 50 + 50) / 100 AS p2, (['bis 1918', '1919-1945', 'nach 1945'])[dom_nutzung % 3 + 1] AS s1, dom_nutzung % 3 + 3 AS s2 FROM buildings), c AS (SELECT *, coalesce(k3, s1) AS coarse3 FROM b)
SELECT bw_geb_id, CASE WHEN k5 IS NOT NULL THEN k5 WHEN coarse3 = 'bis 1918' THEN 1 WHEN coarse3 = '1919-1945' THEN 2 ELSE s2 END AS bp5, coarse3, CASE WHEN k5 IS NOT NULL THEN 'known_bp' WHEN k3 IS NOT NULL THEN 'known_coarse' ELSE 'predicted' END AS source,
CASE WHEN k5 IS NOT NULL THEN 1.0 WHEN coarse3 <> 'nach 1945' THEN CASE WHEN k3 IS NOT NULL THEN 1.0 ELSE round_even(p1, 3) END ELSE round_even(CASE WHEN k3 IS NOT NULL THEN p2 ELSE p1 * p2 END, 3) END AS conf FROM c""",
}
_DENSITY = f"coalesce(MAP {{{', '.join(f'{k!r}: {float(v)}' for k, v in DENSITY.items())}}}[material], {float(DENSITY_DEFAULT)})"
_SQL["balance_of_given_profiles"] = f"""WITH {PARA}, {ELEM}, {IW},
pr(art, material, thickness) AS (VALUES {', '.join(f"('{k}', '{m}', {t})" for k, v in FIXED_PROFILE.items() for m, t in v)}),
x AS (SELECT bauperiode, ort || '/' || el.art AS element, material, area * thickness::DOUBLE AS volume FROM el JOIN pr ON el.art = pr.art WHERE area > 0
  UNION ALL SELECT bauperiode, 'IW/' || kind, material, area * thickness FROM iw WHERE area > 0)
SELECT bauperiode, element, material, round(sum(volume), 3) AS volume, round(sum(volume * {_DENSITY}), 1) AS mass FROM x GROUP BY ALL"""
# a gable of 3 m over the upper side; the inset loses t along each side and gains t^2 cot(angle / 2) at each corner
_SQL["footprint_geometry"] = """WITH a AS (SELECT bw_geb_id, x0, y0, wx, wy, sqrt(wx * wx / 4 + 9) AS e, wx * wy AS ra, wx * 3 / 2 AS ta, atan2(3, wx / 2) AS s FROM buildings)
SELECT bw_geb_id, round(ra + ta, 6) AS area, round(wx + 2 * wy + 2 * e, 6) AS perimeter, 6 AS n_vertices, round(x0 + wx / 2, 6) AS cx, round((ra * (y0 + wy / 2) + ta * (y0 + wy + 1)) / (ra + ta), 6) AS cy,
round(ra + ta - 0.35::DOUBLE * (wx + 2 * wy + 2 * e) + 0.35::DOUBLE * 0.35::DOUBLE * (2 + 2 / tan((pi() / 2 + s) / 2) + 1 / tan((pi() - 2 * s) / 2)), 6) AS net FROM a"""
# vertical sides as in the rectangles; the gables of one row meet the next row's lower sides nowhere along a line
_SQL["footprint_touching"] = """SELECT a.bw_geb_id, round(sum(greatest(0, least(a.y0 + a.wy, o.y0 + o.wy) - greatest(a.y0, o.y0)) * ((a.x0 = o.x0)::INT + (a.x0 = o.x0 + o.wx)::INT + (a.x0 + a.wx = o.x0)::INT + (a.x0 + a.wx = o.x0 + o.wx)::INT)), 4) AS touching
FROM buildings a JOIN buildings o ON a.bw_geb_id <> o.bw_geb_id AND a.x0 <= o.x0 + o.wx AND o.x0 <= a.x0 + a.wx AND a.y0 < o.y0 + o.wy AND o.y0 < a.y0 + a.wy GROUP BY 1 HAVING touching > 0"""
ORACLES = {k: with_views(v, "buildings") for k, v in _SQL.items()}
ORACLES["footprint_contains"] = with_views("""SELECT pt, bw_geb_id FROM (SELECT p.pt, b.bw_geb_id, row_number() OVER (PARTITION BY p.pt ORDER BY b.bw_geb_id) AS rn FROM (SELECT event_id AS pt, value * 2.4 AS x, (job_id % 160)::DOUBLE AS y FROM jobs) p
JOIN buildings b ON p.x >= b.x0 AND p.x < b.x0 + b.wx AND p.y >= b.y0 AND p.y < b.y0 + b.wy + 3 * (1 - abs(p.x - b.x0 - b.wx / 2) / (b.wx / 2))) WHERE rn = 1""", "buildings", "jobs")
ORACLES["point_in_polygon"] = with_views("""SELECT pt, bw_geb_id FROM (SELECT p.pt, b.bw_geb_id, row_number() OVER (PARTITION BY p.pt ORDER BY b.bw_geb_id) AS rn FROM (SELECT event_id AS pt, value * 2.4 AS x, (job_id % 160)::DOUBLE AS y FROM jobs) p JOIN buildings b ON p.x >= b.x0 AND p.x < b.x0 + b.wx AND p.y >= b.y0 AND p.y < b.y0 + b.wy) WHERE rn = 1""", "buildings", "jobs")
