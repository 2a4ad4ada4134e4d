"""Queries of the build-up catalog: Markov model, plausibility, thickness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions.layers import parse_layers, parse_materials
from lithos.operators import markov as mk
from lithos.operators import plausibility
from lithos.operators import thickness as th
from lithos.plans.views import view, with_views
from lithos.session import stored

CELL = mk.CELL


def _layers(spark, d):
    return view(spark, d, "layers")


def _seqs(spark, d):
    return mk.sequences(_layers(spark, d))


def _strings(spark, d):
    """Build-ups as catalog strings, with a beam line and a layer without thickness."""
    text = F.concat(F.lit("("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "material", "thickness"))), lambda x: F.concat(x["material"], F.lit(", "), F.format_string("%.2f", x["thickness"]))), "; "), F.lit("; IPE, 30.00x14.20; Folie)"))
    return _layers(spark, d).groupBy("build_id").agg(text.alias("mat"))


def q_parse_materials(spark, d):
    return _strings(spark, d).select("build_id", F.array_join(parse_materials(F.col("mat")), ";").alias("materials"))


def q_parse_layers(spark, d):
    rows = _strings(spark, d).select("build_id", F.posexplode(parse_layers(F.col("mat"))).alias("i", "x"))
    return rows.select("build_id", (F.col("i") + 1).alias("pos"), "x.material", "x.thickness")


def q_transition_counts(spark, d):
    return mk.counts(_seqs(spark, d)).select(*CELL, "p2", "p1", "next", F.round("mass", 6).alias("mass"))


def q_first_order(spark, d):
    return mk.counts(_seqs(spark, d), 1).select(*CELL, "p1", "next", F.round("mass", 6).alias("mass"))


def q_distributions(spark, d):
    return mk.distributions(_seqs(spark, d)).select("level", "key", "p2", "p1", "next", F.round("p", 8).alias("p"))


def q_scores(spark, d):
    seqs = _seqs(spark, d)
    return mk.scores(seqs, mk.distributions(seqs), "build_id").select("build_id", F.round("score", 8).alias("score"))


def q_references(spark, d):
    seqs = _seqs(spark, d)
    return mk.references(seqs, seqs).select(*CELL, "level", "n_ref")


def q_plausibility(spark, d):
    seqs = mk.condensed(mk.sequences(_layers(spark, d)).withColumn("n", F.lit(1)), n=F.sum("n"))
    ways = seqs.unionByName(seqs.withColumn("seq", F.reverse("seq")))
    asked = stored(ways.groupBy(*CELL, "seq").agg(F.sum("n").alias("n")).withColumn("req_id", F.to_json(F.struct(*CELL, "seq"))))
    got = mk.check(asked, seqs).join(asked.select("req_id", "n"), "req_id")
    return got.groupBy("tier", "reversed").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("mean_score"))


def q_translate(spark, d):
    seqs = stored(_seqs(spark, d).select("build_id", *CELL, "seq", "w"))
    asked = seqs.select(F.col("build_id").alias("req_id"), *CELL, F.transform("seq", lambda m: F.when(m == "STB", "Beton").otherwise(m)).alias("seq"))
    return mk.translate(asked, stored(mk.distributions(mk.condensed(seqs)))).select("req_id", F.array_join("seq", ";").alias("seq"))


def _bodies(seqs):
    """A client's question for every build-up: in the hub's words, as materials or layers, some backwards, some with a
    material that nobody knows, some that are no JSON."""
    said = F.transform("seq", lambda m: F.when(m == "STB", "Beton").otherwise(m))
    by = seqs.select("build_id", *CELL, said.alias("m"))
    n = F.col("build_id")
    by = by.withColumn("m", F.when(n % 5 == 0, F.reverse("m")).otherwise(F.col("m"))).withColumn("m", F.when(n % 7 == 0, F.concat("m", F.array(F.lit("Karton")))).otherwise(F.col("m")))
    place = F.when(F.col("ort") == "DG", "Dach").otherwise(F.col("ort"))
    head = [F.col("bauperiode").alias("period"), place.alias("floor_type"), F.col("art").alias("part_type")]
    flat = F.to_json(F.struct(*head, F.col("m").alias("materials")))
    nested = F.to_json(F.struct(*head, F.transform("m", lambda x: F.struct(x.alias("material"), F.lit(20).alias("thickness"))).alias("layers")))
    body = F.when(n % 101 == 0, "no question").when(n % 3 == 1, nested).otherwise(flat)
    return by.select("build_id", body.alias("body"))


def q_plausibility_answers(spark, d):
    """Build-ups are put together once and written; questions and the catalog are made from them."""
    seqs = stored(_seqs(spark, d).select("build_id", *CELL, "seq", "w"))
    got = plausibility.answers(_bodies(seqs), mk.condensed(seqs))
    return got.select("build_id", "stufe", "label", "detail", "umgekehrt", "referenz_n", F.array_join("gelesen_als", ";").alias("gelesen_als"), "error")


def q_observed_top(spark, d):
    return mk.observed_top(_seqs(spark, d)).withColumn("share", F.round("share", 8))


def q_beam(spark, d):
    seqs = _seqs(spark, d)
    return mk.beam_predict(seqs, mk.distributions(seqs))


def q_match_rate(spark, d):
    """Share of cells whose likeliest sequence is the commonest one."""
    seqs = _seqs(spark, d)
    top = mk.observed_top(seqs, 1).select(*CELL, F.col("seq").alias("observed"))
    beam = mk.beam_predict(seqs, mk.distributions(seqs), 1).select(*CELL, F.col("seq").alias("predicted"))
    return top.join(beam, CELL).agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("observed") == F.col("predicted")).cast("double")).alias("match_rate"))


def q_vocab(spark, d):
    from lithos.vocab import ALIASES, MATERIALS

    have = _layers(spark, d).select(F.col("material").alias("m")).distinct()
    hub = spark.range(1).select(F.explode(F.array(*map(F.lit, MATERIALS))).alias("material"))
    pairs = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("material"), F.lit(x).alias("candidate")) for k, v in ALIASES.items() for x in v])))
    direct = hub.join(have, hub["material"] == have["m"], "left_semi").withColumn("direct", F.lit(True))
    aliased = pairs.join(have, pairs["candidate"] == have["m"], "left_semi").select("material").distinct().withColumn("aliased", F.lit(True))
    return hub.join(direct, "material", "left").join(aliased, "material", "left").select("material", F.when(F.col("aliased"), "translated").when(F.col("direct"), "direct").otherwise("none").alias("kind"))


def q_mean_thickness(spark, d):
    x = _layers(spark, d)
    return th.mean_thickness(x, x).select(*CELL, "material", "level", F.round("t", 8).alias("mean_thickness"))


def q_medians(spark, d):
    return th.medians(_layers(spark, d)).select("material", F.round("median_t", 8).alias("median_t"), "fixed")


def q_leave_one_out(spark, d):
    return th.leave_one_out(_layers(spark, d)).select("build_id", "pos", "level", F.round("seq_mean", 8).alias("seq_mean"))


def q_thickness_error(spark, d):
    m = th.models(_layers(spark, d))
    mae = lambda k: F.round(F.avg(F.abs(F.col(k) - F.col("thickness"))), 8).alias(f"mae_{k}")
    return m.groupBy("material").agg(F.count(F.lit(1)).alias("n"), *[mae(k) for k in "abcd"])


def q_catalog_total(spark, d):
    x = _layers(spark, d)
    return th.catalog_total(x, x).withColumn("T", F.round("T", 8))


S = """s AS (SELECT build_id, bauperiode, ort, art, nettoflaeche, greatest(coalesce(nettoflaeche, 0), 0) + 0.01 AS w, list(material ORDER BY pos) AS seq FROM layers GROUP BY ALL)"""
S = S.replace("GROUP BY ALL", "GROUP BY build_id, bauperiode, ort, art, nettoflaeche")
P = S + """, pad AS (SELECT *, list_concat(['^', '^'], seq, ['$']) AS p FROM s), st AS (SELECT build_id, bauperiode, ort, art, w, i, p[i - 2] AS p2, p[i - 1] AS p1, p[i] AS nx FROM (SELECT *, unnest(range(3, len(p) + 1)) AS i FROM pad))"""
LV = "(VALUES (0), (1), (2), (3)) AS v(level)"
KEY = "CASE level WHEN 0 THEN bauperiode || '|' || ort || '|' || art || '|#0' WHEN 1 THEN ort || '|' || art || '|#1' WHEN 2 THEN art || '|#2' ELSE '#3' END"
DIST = P + f""", cnt AS (SELECT level, {KEY} AS key, p2, p1, nx, sum(w) AS mass FROM st, {LV} GROUP BY ALL
  UNION ALL SELECT level + 4, {KEY}, '', p1, nx, sum(w) FROM st, {LV} GROUP BY ALL),
dist AS (SELECT level, key, p2, p1, nx, mass / total AS p FROM (SELECT *, sum(mass) OVER (PARTITION BY level, key, p2, p1) AS total FROM cnt) WHERE total >= 0.5)"""
L8 = "(VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS v(lv)"
KEY8 = KEY.replace("CASE level", "CASE lv % 4")
STEP = f""", ctx AS (SELECT bauperiode, ort, art, a.p2 AS ask2, a.p1, min((lv, {KEY8}, CASE WHEN lv < 4 THEN a.p2 ELSE '' END)) AS b
  FROM (SELECT DISTINCT bauperiode, ort, art, p2, p1 FROM asked) a, {L8}
  WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT level, key, p2, p1 FROM dist) h WHERE h.level = lv AND h.key = {KEY8} AND h.p2 = CASE WHEN lv < 4 THEN a.p2 ELSE '' END AND h.p1 = a.p1)
  GROUP BY ALL)"""
W_ = "greatest(coalesce(nettoflaeche, 0), 0) + 0.01"
OBS = f"o AS (SELECT level, {KEY} AS key, material, sum(thickness * ({W_})) / sum({W_}) AS t, count(*) AS n FROM layers, {LV} GROUP BY ALL)"

QUERIES = {
    "parse_materials": q_parse_materials,
    "parse_layers": q_parse_layers,
    "weighted_transition_counts": q_transition_counts,
    "first_order_counts": q_first_order,
    "conditional_distributions": q_distributions,
    "sequence_scores": q_scores,
    "reference_sets": q_references,
    "plausibility_tiers": q_plausibility,
    "alias_translation": q_translate,
    "plausibility_answers": q_plausibility_answers,
    "observed_top_k": q_observed_top,
    "beam_predictions": q_beam,
    "top1_match_rate": q_match_rate,
    "vocabulary_report": q_vocab,
    "mean_thickness_backoff": q_mean_thickness,
    "material_medians": q_medians,
    "sequence_mean_leave_one_out": q_leave_one_out,
    "thickness_model_errors": q_thickness_error,
    "catalog_total_thickness": q_catalog_total,
}
_SQL = {
    "parse_materials": "SELECT build_id, string_agg(material, ';' ORDER BY pos) || ';Folie' AS materials FROM layers GROUP BY build_id",
    "parse_layers": "SELECT build_id, pos, material, thickness FROM layers",
    "weighted_transition_counts": f"WITH {P} SELECT bauperiode, ort, art, p2, p1, nx AS next, round(sum(w), 6) AS mass FROM st GROUP BY ALL",
    "first_order_counts": f"WITH {P} SELECT bauperiode, ort, art, p1, nx AS next, round(sum(w), 6) AS mass FROM st GROUP BY ALL",
    "conditional_distributions": f"WITH {DIST} SELECT level, key, p2, p1, nx AS next, round(p, 8) AS p FROM dist",
    "sequence_scores": f"""WITH {DIST}, asked AS (SELECT * FROM st) {STEP},
sp AS (SELECT st.build_id, coalesce(d.p, 0) AS p FROM st LEFT JOIN ctx c ON st.bauperiode = c.bauperiode AND st.ort = c.ort AND st.art = c.art AND st.p2 = c.ask2 AND st.p1 = c.p1
  LEFT JOIN dist d ON d.level = c.b[1] AND d.key = c.b[2] AND d.p2 = c.b[3] AND d.p1 = st.p1 AND d.nx = st.nx)
SELECT build_id, round(CASE WHEN min(p) > 0 THEN exp(avg(ln(nullif(p, 0)))) ELSE 0 END, 8) AS score FROM sp GROUP BY build_id""",
    "reference_sets": f"""WITH {S}, r AS (SELECT level, {KEY} AS key, count(DISTINCT array_to_string(seq, ';')) AS n_ref FROM s, {LV} WHERE level < 3 GROUP BY ALL HAVING count(DISTINCT array_to_string(seq, ';')) >= 2),
c AS (SELECT DISTINCT bauperiode, ort, art FROM s)
SELECT bauperiode, ort, art, b.level, coalesce(b.n_ref, 0) AS n_ref FROM (SELECT c.bauperiode, c.ort, c.art, (SELECT min((r.level, r.n_ref)) FROM r WHERE r.key IN (c.bauperiode || '|' || c.ort || '|' || c.art || '|#0', c.ort || '|' || c.art || '|#1', c.art || '|#2')) AS m FROM c) x, LATERAL (SELECT m[1] AS level, m[2] AS n_ref) b""",
    "observed_top_k": f"""WITH {S}, a AS (SELECT bauperiode, ort, art, array_to_string(seq, ';') AS seq, sum(nettoflaeche) AS area FROM s GROUP BY ALL)
SELECT bauperiode, ort, art, rank, seq, round(area / total, 8) AS share FROM (SELECT *, sum(area) OVER (PARTITION BY bauperiode, ort, art) AS total, (row_number() OVER (PARTITION BY bauperiode, ort, art ORDER BY area DESC, seq))::INT AS rank FROM a) WHERE rank <= 3""",
    "mean_thickness_backoff": f"""WITH {OBS}, a AS (SELECT DISTINCT bauperiode, ort, art, material FROM layers),
f AS (SELECT a.*, v.level, o.t, row_number() OVER (PARTITION BY a.bauperiode, a.ort, a.art, a.material ORDER BY v.level) AS rn FROM a, {LV} JOIN o ON o.level = v.level AND o.key = {KEY.replace('level', 'v.level')} AND o.material = a.material WHERE o.n >= 2 OR v.level = 3)
SELECT bauperiode, ort, art, material, level, round(t, 8) AS mean_thickness FROM f WHERE rn = 1""",
    "material_medians": "SELECT material, round(median(thickness), 8) AS median_t, median(thickness) < 0.03 AS fixed FROM layers GROUP BY material",
    "sequence_mean_leave_one_out": f"""WITH q AS (SELECT build_id, string_agg(material, ';' ORDER BY pos) AS seq FROM layers GROUP BY build_id),
r AS (SELECT l.*, seq, {W_} AS w FROM layers l JOIN q ON l.build_id = q.build_id),
t AS (SELECT level, {KEY} AS key, seq, pos, sum(thickness * w) AS stw, sum(w) AS sw, count(*) AS n FROM r, {LV} GROUP BY ALL HAVING count(*) >= 3),
f AS (SELECT r.build_id, r.pos, v.level, (t.stw - r.thickness * r.w) / (t.sw - r.w) AS m, row_number() OVER (PARTITION BY r.build_id, r.pos ORDER BY v.level) AS rn FROM r, {LV} JOIN t ON t.level = v.level AND t.key = {KEY.replace('level', 'v.level')} AND t.seq = r.seq AND t.pos = r.pos)
SELECT build_id, pos, level, round(m, 8) AS seq_mean FROM f WHERE rn = 1""",
    "catalog_total_thickness": f"""WITH b AS (SELECT build_id, bauperiode, ort, art, sum(thickness) AS staerke FROM layers GROUP BY ALL),
m AS (SELECT level, {KEY} AS key, median(staerke) AS t FROM b, {LV} WHERE level < 3 GROUP BY ALL), c AS (SELECT DISTINCT bauperiode, ort, art FROM b)
SELECT c.bauperiode, c.ort, c.art, round(coalesce(m0.t, m1.t, m2.t, 0.2), 8) AS T FROM c
LEFT JOIN m m0 ON m0.key = c.bauperiode || '|' || c.ort || '|' || c.art || '|#0' LEFT JOIN m m1 ON m1.key = c.ort || '|' || c.art || '|#1' LEFT JOIN m m2 ON m2.key = c.art || '|#2'""",
}


def _vocab_sql() -> str:
    from lithos.vocab import ALIASES, MATERIALS

    hub = ", ".join(f"('{m}')" for m in MATERIALS)
    pairs = ", ".join(f"('{k}', '{x}')" for k, v in ALIASES.items() for x in v)
    return f"WITH h(material) AS (VALUES {hub}), a(material, candidate) AS (VALUES {pairs}), m AS (SELECT DISTINCT material AS m FROM layers) SELECT material, CASE WHEN material IN (SELECT a.material FROM a JOIN m ON candidate = m.m) THEN 'translated' WHEN material IN (SELECT m FROM m) THEN 'direct' ELSE 'none' END AS kind FROM h"


_SQL["vocabulary_report"] = _vocab_sql()
ORACLES = {k: with_views(v, "layers") for k, v in _SQL.items()}
