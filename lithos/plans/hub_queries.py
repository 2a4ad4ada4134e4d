"""Queries of the marketplace, the stored structure, plans, point clouds and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import layers as ly
from lithos.functions import numbers as nb
from lithos.operators import islands as il
from lithos.operators import market as mk
from lithos.operators import structure as st
from lithos.plans.views import view, with_views
from lithos.streaming import jobs as jb
from lithos.vocab import MATERIAL_GROUPS, PRICE_STEPS


def _l(spark, d):
    return view(spark, d, "listings")


KEEP = ["id", "owner_id", "status", "available_from"]


def q_filter(spark, d):
    f = mk.filtered(_l(spark, d), price=(5000, 60000), available_from="1999-06-01", materials=["Ziegel", "Holz"], potentials=["hoch"], statuses=["verbaut", "eingelagert"])
    return f.select(*KEEP[:-1], F.col("available_from").cast("string").alias("available_from"), F.col("price").cast("double").alias("price"))


def q_unit(spark, d):
    return mk.filtered(_l(spark, d), quantity=40).groupBy("component_category", nb.canonical_unit(F.col("unit")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def q_counts(spark, d):
    return mk.category_counts(mk.visible(_l(spark, d)))


def q_dedupe(spark, d):
    return mk.deduped(_l(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("total"))


def q_search(spark, d):
    return mk.search(_l(spark, d), "  Holz ").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_similar(spark, d):
    b = view(spark, d, "buildings").select(F.col("bw_geb_id").alias("id"), F.col("dom_nutzung").alias("kind"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return mk.similar(b, 25.0)


def q_range(spark, d):
    text = F.element_at(F.array(F.lit("beliebig"), F.concat(F.col("l").cast("string"), F.lit(",5 €")), F.lit("abc")), (F.col("id") % 3 + 1).cast("int"))
    rows = _l(spark, d).select("id", "price").withColumn("l", F.floor(F.col("price").cast("double") / 100).cast("long"))
    low, high = nb.price_range(nb.parse_user_number(text), nb.parse_user_number(F.concat(F.col("l").cast("string"), F.lit(".000"))))
    rows = rows.select("id", low.alias("low"), F.when(high == nb.INFINITY, F.lit(-1.0)).otherwise(high).alias("high"))
    return rows.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


def _options():
    out, at = [0.0], 0
    for upto, step in PRICE_STEPS:
        while at < upto:
            at += step
            out.append(float(at))
    return out


def q_slider(spark, d):
    return _l(spark, d).select(nb.slider_index(F.col("price").cast("double") * 2, _options()).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


def q_violations(spark, d):
    rows = _l(spark, d).withColumns({"price": F.col("price").cast("double") - 2000, "status": F.when(F.col("id") % 11 == 0, "weg").otherwise(F.col("status")), "name": F.when(F.col("id") % 13 == 0, "  ").otherwise(F.col("name"))})
    return rows.select(F.explode(st.violations(st.listing_rules())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def q_part_validity(spark, d):
    x = view(spark, d, "layers").groupBy("build_id", "nettoflaeche").agg(F.sort_array(F.collect_list(F.struct("pos", "material", (F.col("thickness") * 10 - 0.5).alias("thickness")))).alias("layers"))
    return x.select("build_id", st.valid_part(F.col("nettoflaeche") / 100, F.col("layers"), ["Holz"]).alias("valid"), (F.round(ly.total_thickness(F.col("layers"), ["Holz"]), 6) + 0.0).alias("total"))


def q_reindex(spark, d):
    x = view(spark, d, "layers").groupBy("build_id").agg(F.sort_array(F.collect_list(F.struct("pos", "material", (F.col("thickness") * 25).alias("thickness")))).alias("layers"))
    return x.select("build_id", F.explode(ly.reindexed(F.col("layers"), ["Holz"])).alias("l")).select("build_id", "l.layer_index", "l.material", "l.thickness")


def q_labels(spark, d):
    x = view(spark, d, "layers").select(F.col("build_id").alias("building_id"), "pos", F.when(F.col("material") == "Holz", "Dach").when(F.col("thickness") > 0.25, "RG").otherwise("KG").alias("type"))
    return st.storey_labels(x)


def q_reallocate(spark, d):
    s = view(spark, d, "segments").select("seg_id", "no", F.when(F.col("group_id") == 0, None).otherwise(F.col("plan_id")).alias("source_extract_id"))
    return st.reallocate(s, s.where("no > 3"))[1]


def q_latest_structure(spark, d):
    return _l(spark, d).groupBy("building_id").agg(F.max(F.struct("created_at", "id")).alias("m")).select("building_id", F.col("m.id").alias("id"))


def q_foreign_key(spark, d):
    gone = _l(spark, d).groupBy("owner_id").agg(F.min("price").alias("m")).where("m < 950").select("owner_id")
    return _l(spark, d).join(gone, "owner_id", "left_anti").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_schema_diff(spark, d):
    rows = view(spark, d, "layers")
    # as EXCEPT ALL both ways, from one count of either side's rows
    by = rows.groupBy("build_id", "material").agg(F.count_if(F.col("thickness") <= 0.3).alias("a"), F.count_if(F.col("thickness") >= 0.2).alias("b"))
    sides = F.array(F.struct(F.lit("left").alias("side"), (F.col("a") - F.col("b")).alias("n")), F.struct(F.lit("right").alias("side"), (F.col("b") - F.col("a")).alias("n")))
    return by.select("material", F.inline(sides)).where("n > 0").groupBy("material", "side").agg(F.sum("n").alias("n")).select("material", "n", "side")


def q_extract_ids(spark, d):
    return view(spark, d, "segments").select("plan_id").distinct().select("plan_id", nb.name_uuid(F.concat_ws("|", F.col("plan_id").cast("string"), F.lit("RG"))).alias("extract_id"))


def q_run_length(spark, d):
    s = view(spark, d, "segments")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(F.col("x1"), F.col("y1")), p(F.col("x2"), F.col("y1")), p(F.col("x2"), F.col("y2") + 2), p(F.col("x1"), F.col("y2") + 2))
    return s.select("plan_id", F.when(F.col("thickness_m") > 0, il.shoelace(ring) / F.col("thickness_m")).otherwise(0.0).alias("run")).groupBy("plan_id").agg(F.round(F.sum("run"), 4).alias("run"))


def q_wall_rows(spark, d):
    s = view(spark, d, "segments").where("group_id > 0")
    return s.groupBy("plan_id", "group_id", "part_type").agg(F.round(F.sum(F.col("length_mm") / 1000), 6).alias("length_m"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.abs(F.col("thickness_m") * 1000 - 120) >= 5).cast("double")), 6).alias("warned"))


def q_completion(spark, d):
    s = view(spark, d, "segments")
    return s.groupBy("plan_id").agg(F.round(100 * F.avg((F.col("group_id") > 0).cast("double")), 6).alias("percent"))


def q_segment_dedupe(spark, d):
    s = view(spark, d, "segments")
    a, b = (F.struct(F.round(x, 3).alias("x"), F.round(y, 3).alias("y")) for x, y in ((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))))
    return s.select("plan_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


def q_voxels(spark, d):
    return il.voxels(view(spark, d, "points"), 0.5).select("scan_id", "ix", "iy", "iz", "n", *[F.round(c, 9).alias(c) for c in "xyz"])


def q_occupancy(spark, d):
    return il.occupancy(view(spark, d, "points"), 0.2, 0.05)


def q_peaks(spark, d):
    return il.peaks(il.occupancy(view(spark, d, "points"), 0.2, 0.25), 0.5)


def q_islands(spark, d):
    s = il.islands(view(spark, d, "segments").select("plan_id", "x1").distinct(), ["plan_id"], "x1", 1.5, [])
    return s.groupBy("plan_id", "island").agg(F.min("x1").alias("start"), F.max("x1").alias("stop"), F.count(F.lit(1)).alias("n"))


def q_palette(spark, d):
    return il.palette(view(spark, d, "segments"), ["plan_id"], "thickness_m", 0.015, 0.1)


def q_direction(spark, d):
    s = view(spark, d, "segments").withColumn("angle", F.col("x1") * 3.6)
    return s.groupBy("plan_id").agg(F.round(il.circular_mean("angle", "length_mm"), 4).alias("direction"))


def q_job_states(spark, d):
    return jb.latest(view(spark, d, "jobs")).select("job_id", "status", "n_events")


def q_job_starts(spark, d):
    return jb.starts(view(spark, d, "jobs")).select("job_id", "start_id", "n_starts")


def q_job_windows(spark, d):
    return jb.windowed_counts(view(spark, d, "jobs"))


def q_job_stream(spark, d):
    return jb.stream_counts(spark, d)


def q_job_poller(spark, d):
    return jb.polled(spark, d)


def q_error_lines(spark, d):
    at = F.concat(F.lit("failed at /srv/jobs/"), F.col("job_id").cast("string"), F.lit("/run.py: "), F.col("status"), F.lit("\ntrace"))
    text = F.when(F.col("event_id") % 3 == 0, at).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" C:\\jobs\\"), F.col("status"), F.lit(".py \n"), at))
    return view(spark, d, "jobs").select(nb.first_error_line(text, F.concat(F.lit("Error"), F.col("status"))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "listing_filter": q_filter, "listing_units": q_unit, "category_counts": q_counts, "listing_dedupe": q_dedupe, "listing_search": q_search,
    "similar_within_radius": q_similar, "price_ranges": q_range, "price_slider": q_slider, "rule_violations": q_violations, "part_validity": q_part_validity,
    "layer_reindex": q_reindex, "storey_labels": q_labels, "import_reallocation": q_reallocate, "latest_structure": q_latest_structure,
    "foreign_key_cascade": q_foreign_key, "schema_difference": q_schema_diff, "extract_ids": q_extract_ids, "run_lengths": q_run_length, "wall_rows": q_wall_rows,
    "plan_completion": q_completion, "segment_dedupe": q_segment_dedupe, "voxel_downsample": q_voxels, "occupancy_profile": q_occupancy, "profile_peaks": q_peaks,
    "gap_islands": q_islands, "thickness_palette": q_palette, "mean_direction": q_direction, "job_states": q_job_states, "job_starts": q_job_starts,
    "job_windows": q_job_windows, "job_stream": q_job_stream, "job_poller": q_job_poller, "error_lines": q_error_lines,
}
UNIT = "CASE unit WHEN 'Stueck' THEN 'Stück' WHEN 'Stück' THEN 'Stück' WHEN 'm3' THEN 'Kubikmeter' WHEN 'kg' THEN 'Kilogramm' END"
GROUPS = ", ".join(f"('{m}', '{g}')" for g, ms in MATERIAL_GROUPS.items() for m in ms)
OPTS = ", ".join(f"({i}, {o})" for i, o in enumerate(_options()))
TYPE = "CASE WHEN material = 'Holz' THEN 'Dach' WHEN thickness > 0.25 THEN 'RG' ELSE 'KG' END"
_V = {
    "listing_filter": ("listings", "SELECT id, owner_id, status, available_from::VARCHAR AS available_from, price::DOUBLE AS price FROM listings WHERE status <> 'verkauft' AND price BETWEEN 5000 AND 60000 AND available_from <= DATE '1999-06-01' AND material IN ('Ziegel', 'Holz') AND potential = 'hoch'"),
    "listing_units": ("listings", f"SELECT component_category, {UNIT} AS unit, count(*) AS n FROM listings WHERE status <> 'verkauft' AND quantity >= 40 AND (component_category <> 'Objekt' OR {UNIT} = 'Stück') GROUP BY ALL"),
    "category_counts": ("listings", f"WITH g(m, grp) AS (VALUES {GROUPS}), v AS (SELECT * FROM listings WHERE status <> 'verkauft') SELECT 'object_type' AS kind, object_type AS value, count(*) AS n FROM v WHERE component_category = 'Objekt' GROUP BY ALL UNION ALL SELECT 'group', grp, count(*) FROM v JOIN g ON material = m WHERE component_category <> 'Objekt' GROUP BY ALL"),
    "listing_dedupe": ("listings", "SELECT status, count(*) AS n, sum(price)::DOUBLE AS total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, price DESC, quantity DESC, owner_id) AS rn FROM listings) WHERE rn = 1 GROUP BY status"),
    "listing_search": ("listings", "SELECT status, count(*) AS n FROM listings WHERE contains(lower(concat_ws(' ', name, material, object_type)), 'holz') AND status <> 'verkauft' GROUP BY status"),
    "similar_within_radius": ("buildings", "SELECT a.bw_geb_id AS id, b.bw_geb_id AS other, round(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)), 6) AS distance_m FROM buildings a JOIN buildings b ON a.bw_geb_id <> b.bw_geb_id AND a.dom_nutzung = b.dom_nutzung AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 625"),
    "price_ranges": ("listings", "WITH a AS (SELECT id, floor(price::DOUBLE / 100)::BIGINT AS l FROM listings), b AS (SELECT CASE id % 3 WHEN 1 THEN l + 0.5 ELSE 0 END::DOUBLE AS x, CASE WHEN l < 1000 THEN l * 1000 ELSE l END::DOUBLE AS y FROM a) SELECT least(x, y) AS low, greatest(x, y) AS high, count(*) AS n FROM b GROUP BY ALL"),
    "price_slider": ("listings", f"WITH o(i, v) AS (VALUES {OPTS}), p AS (SELECT DISTINCT price::DOUBLE * 2 AS p FROM listings), b AS (SELECT p, min((abs(p - v), i)) AS m FROM p, o GROUP BY p) SELECT CASE WHEN p > 100000 THEN (SELECT count(*) FROM o) ELSE m[2] END AS idx, count(*) AS n FROM listings JOIN b ON p = price::DOUBLE * 2 GROUP BY 1"),
    "rule_violations": ("listings", "SELECT 'price' AS rule, count(*) AS n FROM listings WHERE price::DOUBLE < 2000 HAVING count(*) > 0 UNION ALL SELECT 'status', count(*) FROM listings WHERE id % 11 = 0 HAVING count(*) > 0 UNION ALL SELECT 'name', count(*) FROM listings WHERE id % 13 = 0 HAVING count(*) > 0"),
    "part_validity": ("layers", "SELECT build_id, nettoflaeche / 100 >= 1 AND bool_or(material <> 'Holz' AND thickness * 10 - 0.5 > 0) AND bool_and(material = 'Holz' OR thickness * 10 - 0.5 >= 1) AS valid, round(coalesce(sum(thickness * 10 - 0.5) FILTER (material <> 'Holz'), 0), 6) + 0.0::DOUBLE AS total FROM layers GROUP BY build_id, nettoflaeche"),
    "layer_reindex": ("layers", "SELECT build_id, pos AS layer_index, material, CASE WHEN material = 'Holz' THEN 0 ELSE greatest(0, floor(thickness * 25 + 0.5))::BIGINT END AS thickness FROM layers"),
    "storey_labels": ("layers", f"SELECT building_id, pos, type, CASE WHEN type = 'Dach' THEN type ELSE type || ' ' || row_number() OVER (PARTITION BY building_id, type ORDER BY pos) END AS label FROM (SELECT build_id AS building_id, pos, {TYPE} AS type FROM layers)"),
    "import_reallocation": ("segments", "WITH s AS (SELECT no, CASE WHEN group_id = 0 THEN NULL ELSE plan_id END AS e FROM segments) SELECT e AS source_extract_id, count(*) AS deleted, count(*) FILTER (no > 3) AS inserted FROM s WHERE e IS NOT NULL GROUP BY e HAVING count(*) FILTER (no > 3) > 0"),
    "latest_structure": ("listings", "SELECT building_id, (max((created_at, id)))[2] AS id FROM listings GROUP BY building_id"),
    "foreign_key_cascade": ("listings", "SELECT status, count(*) AS n FROM listings WHERE owner_id NOT IN (SELECT owner_id FROM listings GROUP BY owner_id HAVING min(price) < 950) GROUP BY status"),
    "schema_difference": ("layers", "WITH a AS (SELECT build_id, material FROM layers WHERE thickness <= 0.3), b AS (SELECT build_id, material FROM layers WHERE thickness >= 0.2) SELECT material, count(*) AS n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY material UNION ALL SELECT material, count(*), 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY material"),
    "extract_ids": ("segments", "SELECT plan_id, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[(('0x' || h[17:17])::INT & 3) + 1] || h[18:20] || '-' || h[21:32] AS extract_id FROM (SELECT DISTINCT plan_id, sha256(plan_id || '|RG') AS h FROM segments)"),
    "run_lengths": ("segments", "SELECT plan_id, round(sum((x2 - x1) * 2 / thickness_m), 4) AS run FROM segments GROUP BY plan_id"),
    "wall_rows": ("segments", "SELECT plan_id, group_id, part_type, round(sum(length_mm / 1000), 6) AS length_m, count(*) AS n, round(avg((abs(thickness_m * 1000 - 120) >= 5)::INT), 6) AS warned FROM segments WHERE group_id > 0 GROUP BY ALL"),
    "plan_completion": ("segments", "SELECT plan_id, round(100 * avg((group_id > 0)::INT), 6) AS percent FROM segments GROUP BY plan_id"),
    "segment_dedupe": ("segments", "SELECT plan_id, count(*) AS n FROM (SELECT DISTINCT plan_id, least((round(x1, 3), round(y1, 3)), (round(x2, 3), round(y2, 3))) AS a, greatest((round(x1, 3), round(y1, 3)), (round(x2, 3), round(y2, 3))) AS b FROM segments) GROUP BY plan_id"),
    "voxel_downsample": ("points", "SELECT scan_id, floor(x / 0.5)::BIGINT AS ix, floor(y / 0.5)::BIGINT AS iy, floor(z / 0.5)::BIGINT AS iz, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM points GROUP BY 1, 2, 3, 4"),
    "occupancy_profile": ("points", "SELECT scan_id, floor(z / 0.05::DOUBLE)::BIGINT AS iz, count(DISTINCT (floor(x / 0.2::DOUBLE)::BIGINT, floor(y / 0.2::DOUBLE)::BIGINT)) AS cells FROM points GROUP BY 1, 2"),
    "profile_peaks": ("points", "WITH p AS (SELECT scan_id, floor(z / 0.25::DOUBLE)::BIGINT AS iz, count(DISTINCT (floor(x / 0.2::DOUBLE)::BIGINT, floor(y / 0.2::DOUBLE)::BIGINT)) AS cells FROM points GROUP BY 1, 2), t AS (SELECT scan_id, max(cells) AS top FROM p GROUP BY 1) SELECT p.scan_id, p.iz, p.cells FROM p JOIN t ON p.scan_id = t.scan_id LEFT JOIN p b ON b.scan_id = p.scan_id AND b.iz = p.iz - 1 LEFT JOIN p a ON a.scan_id = p.scan_id AND a.iz = p.iz + 1 WHERE p.cells >= coalesce(b.cells, 0) AND p.cells > coalesce(a.cells, 0) AND p.cells >= 0.5 * top"),
    "gap_islands": ("segments", "WITH d AS (SELECT DISTINCT plan_id, x1 FROM segments), h AS (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY plan_id ORDER BY x1) > 1.5 THEN 1 ELSE 0 END AS h FROM d), i AS (SELECT *, sum(h) OVER (PARTITION BY plan_id ORDER BY x1)::BIGINT AS island FROM h) SELECT plan_id, island, min(x1) AS start, max(x1) AS stop, count(*) AS n FROM i GROUP BY ALL"),
    "thickness_palette": ("segments", "WITH h AS (SELECT *, CASE WHEN thickness_m - lag(thickness_m) OVER (PARTITION BY plan_id ORDER BY thickness_m) > 0.015 THEN 1 ELSE 0 END AS h FROM segments), i AS (SELECT *, sum(h) OVER (PARTITION BY plan_id ORDER BY thickness_m ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM h) SELECT plan_id, island, count(*) AS n, greatest(round(median(thickness_m), 2), 0.1) AS value FROM i GROUP BY ALL"),
    "mean_direction": ("segments", "SELECT plan_id, round(CASE WHEN m < 0 THEN m + 180 ELSE m END, 4) AS direction FROM (SELECT plan_id, degrees(atan2(sum(sin(radians(x1 * 3.6 * 2)) * length_mm), sum(cos(radians(x1 * 3.6 * 2)) * length_mm))) / 2 AS m FROM segments GROUP BY plan_id)"),
    "job_states": ("jobs", "SELECT job_id, (max((ts, event_id, status)))[3] AS status, count(*) AS n_events FROM jobs GROUP BY job_id"),
    "job_starts": ("jobs", "SELECT job_id, min(event_id) AS start_id, count(*) AS n_starts FROM jobs WHERE status = 'queued' GROUP BY job_id, date_trunc('hour', ts)"),
    "job_windows": ("jobs", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, status, count(*) AS n FROM jobs GROUP BY ALL"),
    "error_lines": ("jobs", "SELECT CASE WHEN event_id % 3 = 0 THEN 'failed at : ' || status ELSE 'Error' || status END AS line, count(*) AS n FROM jobs GROUP BY 1"),
}
ORACLES = {k: with_views(sql, v) for k, (v, sql) in _V.items()}
