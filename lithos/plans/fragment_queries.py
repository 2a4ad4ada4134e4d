"""Queries of wall fragments, on fragments derived from plan segments: about a thousand to a scan, whatever the scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.operators import fragments as fr
from lithos.plans.views import view, with_views

#: In SQL that Spark and DuckDB both run: pieces of up to five metres in four directions, a quarter of a metre apart.
_TURN = "radians(CAST(CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 37 ELSE 90 END AS DOUBLE))"
_PLACED = "SELECT seg_id * 10 + no AS id, CAST(floor(seg_id / 1000) AS BIGINT) AS scan_id, min(x1) * 2.0 AS x, min(y1) * 0.25 AS y, min(length_mm) / 100 AS len, min(group_id) AS g FROM segments GROUP BY seg_id, no"
FRAGMENTS = f"""SELECT scan_id, id, x AS x1, y AS y1, x + len * cos({_TURN}) AS x2, y + len * sin({_TURN}) AS y2,
CAST(g % 2 * 1.5 AS DOUBLE) AS z_base, CAST(2.5 - g % 3 * 0.5 AS DOUBLE) AS height, CAST(0.1 AS DOUBLE) AS thickness FROM ({_PLACED})"""


def _fragments(spark, d):
    return spark.sql(FRAGMENTS.replace("FROM segments", "FROM {segments}"), segments=view(spark, d, "segments"))


def _links(links):
    def query(spark, d):
        return links(fr._figures(_fragments(spark, d)))

    return query


def _rounded(walls):
    return walls.select("scan_id", "id", *[(F.round(k, 6) + 0.0).alias(k) for k in fr.SHAPE], "n_fragments")


QUERIES = {
    "fragment_links": _links(fr.collinear_links),
    "face_links": _links(fr.face_links),
    "joined_fragments": lambda spark, d: _rounded(fr.joined_fragments(_fragments(spark, d))),
    "joined_faces": lambda spark, d: _rounded(fr.joined_faces(_fragments(spark, d))),
}
# all pairs of a scan
_PAIRS = f"""WITH f AS MATERIALIZED ({FRAGMENTS}), g AS MATERIALIZED (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, atan2(y2 - y1, x2 - x1) AS dir FROM f),
p AS (SELECT a.scan_id, a.id AS a, b.id AS b, abs(a.dir - b.dir) AS apart, (a.dir + b.dir) / 2 + CASE WHEN abs(a.dir - b.dir) > pi() / 2 THEN pi() / 2 ELSE 0 END AS m,
  a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.mx - a.mx AS dx, b.my - a.my AS dy,
  a.z_base AS az, b.z_base AS bz, a.z_base + a.height AS a_top, b.z_base + b.height AS b_top FROM g a JOIN g b ON a.scan_id = b.scan_id AND a.id < b.id),
q AS (SELECT *, abs(dy * cos(m) - dx * sin(m)) AS off, ax1 * cos(m) + ay1 * sin(m) AS p1, ax2 * cos(m) + ay2 * sin(m) AS p2, bx1 * cos(m) + by1 * sin(m) AS q1, bx2 * cos(m) + by2 * sin(m) AS q2
  FROM p WHERE degrees(least(apart, pi() - apart)) <= 12 + 1e-9),
s AS (SELECT *, least(p1, p2) AS a0, greatest(p1, p2) AS a1, least(q1, q2) AS b0, greatest(q1, q2) AS b1 FROM q)
SELECT scan_id, a, b FROM s WHERE """
ORACLES = {
    "fragment_links": with_views(_PAIRS + "off <= 0.2 + 1e-9 AND greatest(a0, b0) - least(a1, b1) <= 0.8 + 1e-9 AND abs(az - bz) <= 1.2 + 1e-9 AND abs(a_top - b_top) <= 3 + 1e-9", "segments"),
    "face_links": with_views(_PAIRS + "off <= 0.4 + 1e-9 AND least(a1, b1) - greatest(a0, b0) > 1e-9 AND least(a1, b1) - greatest(a0, b0) >= (0.4 - 1e-9) * (greatest(a1, b1) - least(a0, b0))", "segments"),
}
