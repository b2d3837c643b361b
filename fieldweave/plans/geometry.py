"""Leaf geometry over point tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import excess_green
from ..operators import geometry as G
from . import roles as R
from .registry import q, query, r

_T = f"""(SELECT image, count(*) AS n, avg(x) AS cx, avg(y) AS cy, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS th FROM {R.POINTS} p GROUP BY image)"""
_M = f"""(SELECT image, n, cx, cy, cos(th) * s AS ax, sin(th) * s AS ay, -sin(th) * t AS px, cos(th) * t AS py FROM (SELECT *,
  CASE WHEN (CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN cos(th) ELSE sin(th) END) < 0 THEN -1 ELSE 1 END AS s,
  CASE WHEN (CASE WHEN abs(sin(th)) >= abs(cos(th)) THEN -sin(th) ELSE cos(th) END) < 0 THEN -1 ELSE 1 END AS t FROM {_T} z) y)"""
_S = f"""(SELECT image, any_value(n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, any_value(ax) AS ax, any_value(ay) AS ay, any_value(px) AS px, any_value(py) AS py,
  min((x - cx) * ax + (y - cy) * ay) AS a0, max((x - cx) * ax + (y - cy) * ay) AS a1,
  min((x - cx) * px + (y - cy) * py) AS b0, max((x - cx) * px + (y - cy) * py) AS b1 FROM {R.POINTS} p JOIN {_M} m USING (image) GROUP BY image)"""
_AXES = f"""(SELECT image, n, cx, cy, CASE WHEN sw THEN px ELSE ax END AS axis_x, CASE WHEN sw THEN py ELSE ay END AS axis_y,
  CASE WHEN sw THEN ax ELSE px END AS perp_x, CASE WHEN sw THEN ay ELSE py END AS perp_y, CASE WHEN sw THEN b0 ELSE a0 END AS min_proj, CASE WHEN sw THEN b1 ELSE a1 END AS max_proj,
  CASE WHEN sw THEN a0 ELSE b0 END AS min_perp, CASE WHEN sw THEN a1 ELSE b1 END AS max_perp FROM (SELECT *, b1 - b0 > a1 - a0 AS sw FROM {_S} s) y)"""


@query("leaf_axes", f"""SELECT image, n AS n_points, {q("cx", 3)} AS cx, {q("cy", 3)} AS cy, {q("axis_x")} AS axis_x, {q("axis_y")} AS axis_y,
  {q("((degrees(atan2(axis_y, axis_x)) + 360) % 180)", 3)} AS angle, {q("max_proj - min_proj", 3)} AS length, {q("max_perp - min_perp", 3)} AS width FROM {_AXES} a""")
def leaf_axes(t):
    a = G.leaf_axes(R.points(t))
    return a.select("image", "n_points", *[r(c, 3).alias(c) for c in ("cx", "cy")], r("axis_x").alias("axis_x"), r("axis_y").alias("axis_y"), *[r(c, 3).alias(c) for c in ("angle", "length", "width")])


_PROJ = f"""(SELECT p.*, a.* EXCLUDE (image), (x - cx) * axis_x + (y - cy) * axis_y AS along, (x - cx) * perp_x + (y - cy) * perp_y AS across FROM {R.POINTS} p JOIN {_AXES} a USING (image))"""
_K = f"""(SELECT image, unnest(range(0, floor((max_proj - min_proj - 30) / 10)::BIGINT + 1)) AS k, * EXCLUDE (image) FROM {_AXES} a)"""


@query("crop_windows", f"""WITH w AS (SELECT k.image, k.k, count(*) AS n_points, avg(across) AS off, any_value(k.cx) AS cx, any_value(k.cy) AS cy, any_value(k.axis_x) AS ax, any_value(k.axis_y) AS ay, any_value(k.perp_x) AS px, any_value(k.perp_y) AS py,
  any_value(k.min_proj) + k.k * 10 + 15 AS mid FROM {_K} k JOIN {_PROJ} p ON p.image = k.image AND along - p.min_proj BETWEEN k.k * 10 AND k.k * 10 + 30 GROUP BY k.image, k.k),
  c AS (SELECT image, k, n_points, cx + mid * ax + off * px AS x, cy + mid * ay + off * py AS y, ax, ay, px, py FROM w)
  SELECT image, k, n_points, {q("x", 3)} AS center_x, {q("y", 3)} AS center_y, {q("x - 15 * ax - 10 * px", 3)} AS corner_0_x, {q("y + 15 * ay + 10 * py", 3)} AS corner_2_y,
  (x - 15 * ax - 10 * px >= 0 AND x - 15 * ax - 10 * px < 60 AND x + 15 * ax - 10 * px >= 0 AND x + 15 * ax - 10 * px < 60 AND x + 15 * ax + 10 * px >= 0 AND x + 15 * ax + 10 * px < 60 AND x - 15 * ax + 10 * px >= 0 AND x - 15 * ax + 10 * px < 60
   AND y - 15 * ay - 10 * py >= 0 AND y - 15 * ay - 10 * py < 110 AND y + 15 * ay - 10 * py >= 0 AND y + 15 * ay - 10 * py < 110 AND y + 15 * ay + 10 * py >= 0 AND y + 15 * ay + 10 * py < 110 AND y - 15 * ay + 10 * py >= 0 AND y - 15 * ay + 10 * py < 110) AS in_bounds FROM c""")
def crop_windows(t):
    p = R.points(t)
    w = G.crop_windows(p, G.leaf_axes(p), 30.0, 20.0, 10.0, 60.0, 110.0)
    return w.select("image", "k", "n_points", *[r(c, 3).alias(c) for c in ("center_x", "center_y", "corner_0_x", "corner_2_y")], "in_bounds")


@query("cross_profile", f"""WITH b AS (SELECT image, least(floor((across - min_perp) / (max_perp - min_perp) * 100), 99)::INT AS bin, avg((2 * g - r - b) / nullif(r + g + b, 0)) AS m FROM {_PROJ} p GROUP BY 1, 2),
  g AS (SELECT image, unnest(range(0, 100))::INT AS bin FROM {_AXES} a),
  f AS (SELECT g.image, g.bin, m, last_value(CASE WHEN m IS NOT NULL THEN g.bin END IGNORE NULLS) OVER w AS lb, last_value(m IGNORE NULLS) OVER w AS lm,
    first_value(CASE WHEN m IS NOT NULL THEN g.bin END IGNORE NULLS) OVER v AS rb, first_value(m IGNORE NULLS) OVER v AS rm FROM g LEFT JOIN b ON b.image = g.image AND b.bin = g.bin
    WINDOW w AS (PARTITION BY g.image ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY g.image ORDER BY g.bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT image, bin, {q("CASE WHEN lb IS NULL THEN rm WHEN rb IS NULL THEN lm WHEN lb = rb THEN m ELSE lm + (rm - lm) * (bin - lb) / (rb - lb) END")} AS value, m IS NULL AS interpolated FROM f""")
def cross_profile(t):
    p = R.points(t)
    c = G.cross_profile(p, G.leaf_axes(p), excess_green(F.col("r"), F.col("g"), F.col("b")))
    return c.select("image", "bin", r("value").alias("value"), "interpolated")
