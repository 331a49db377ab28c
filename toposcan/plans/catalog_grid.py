"""Raster-cell operators, connected components and buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.operators import aggregates as agg, components as comp, grid
from toposcan.plans.catalog_metrics import round_all
from toposcan.plans.catalog_space import diamonds
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.sqltext import merc_x, merc_y
from toposcan.plans.views import d

WEST, NORTH, SIZE = -74.0, -5.0, 0.1


@query("grd1_create_grid", f"""
    WITH b AS (SELECT min(lon) AS w, min(lat) AS s, CAST(ceil((max(lon) - min(lon)) / 0.25e0) AS BIGINT) AS nx,
                      CAST(ceil((max(lat) - min(lat)) / 0.25e0) AS BIGINT) AS ny FROM {{v_feature}})
    SELECT id AS grid_id, {q6("w + (id // ny) * 0.25e0")} AS minx, {q6("s + (id % ny) * 0.25e0")} AS miny, {q6("w + (id // ny + 1) * 0.25e0")} AS maxx,
           {q6("s + (id % ny + 1) * 0.25e0")} AS maxy FROM (SELECT *, unnest(range(nx * ny)) AS id FROM b)""")
def _(v):
    return rounded(grid.grid_of(v("v_feature"), 0.25), "minx", "miny", "maxx", "maxy")


CLEAN = "(SELECT tile, row, col, nullif(value, 255) AS value FROM {v_cell})"


def clean(v):
    return v("v_cell").withColumn("value", F.nullif(F.col("value"), F.lit(255.0)))


@query("grd2_sample_points", f"""
    WITH m AS (SELECT row, col, avg(value) AS occ FROM {CLEAN} GROUP BY 1, 2)
    SELECT feature_id, {q6("coalesce(occ, 0)")} AS occ_pct FROM {{v_feature}} f LEFT JOIN m
    ON m.row = CAST(floor((-5 - lat) / 0.1e0) AS INT) AND m.col = CAST(floor((lon + 74) / 0.1e0) AS INT)""")
def _(v):
    return rounded(grid.sample_points(v("v_feature"), clean(v), WEST, NORTH, SIZE), "occ_pct").select("feature_id", "occ_pct")


@query("grd3_buffer_stats", f"""
    WITH c AS (SELECT {merc_x("-74 + (col + 0.5e0) * 0.1e0")} AS x, {merc_y("-5 - (row + 0.5e0) * 0.1e0")} AS y, value FROM {CLEAN} WHERE value IS NOT NULL),
    p AS (SELECT site_id, {merc_x("lon")} AS px, {merc_y("lat")} AS py FROM {{v_site}}),
    h AS (SELECT site_id, value FROM p JOIN c ON x BETWEEN px - 15000 AND px + 15000 AND y BETWEEN py - 15000 AND py + 15000
          WHERE sqrt(pow(x - px, 2) + pow(y - py, 2)) <= 15000)
    SELECT p.site_id, {q6("avg(value)")} AS mean, max(value) AS max, min(value) AS min, count(value) AS count FROM p LEFT JOIN h USING (site_id) GROUP BY 1""")
def _(v):
    return rounded(grid.buffer_stats(v("v_site"), clean(v), WEST, NORTH, SIZE, 15.0), "mean")


CENTRED = f"(SELECT tile, row, col, -74 + (col + 0.5e0) * 0.1e0 AS cx, -5 - (row + 0.5e0) * 0.1e0 AS cy, value FROM {CLEAN})"
INSIDE = "abs(cx - x1) + abs(cy - y1) < 0.3507e0"


def centred(v):
    return grid.with_centres(clean(v), WEST, NORTH, SIZE)


@query("grd4_zonal_stats", f"""
    SELECT river_id, {q6("avg(value)")} AS mean, {q6("stddev_pop(value)")} AS std, min(value) AS min, max(value) AS max, {q6("sum(value)")} AS sum,
           count(value) AS count FROM {{v_river}} JOIN {CENTRED} ON {INSIDE} WHERE value IS NOT NULL GROUP BY river_id""")
def _(v):
    return rounded(grid.zonal_stats(centred(v), diamonds(v, 0.3507), "river_id", 0.5), "mean", "std", "sum")


@query("grd5_rasterize_points", f"""
    WITH h AS (SELECT CAST(floor((-5 - lat) / 0.1e0) AS INT) AS row, CAST(floor((lon + 74) / 0.1e0) AS INT) AS col, arg_max(acctbal, site_id) AS v FROM {{v_site}} GROUP BY 1, 2)
    SELECT row, col, coalesce(v, 0) AS value FROM (SELECT DISTINCT row, col FROM {{v_cell}}) LEFT JOIN h USING (row, col)""")
def _(v):
    frame = v("v_cell").select("row", "col").distinct()
    return grid.rasterize_points(frame, v("v_site"), WEST, NORTH, SIZE, "acctbal", "site_id")


@query("grd5_rasterize_polygons", f"""
    WITH c AS (SELECT DISTINCT row, col, cx, cy FROM {CENTRED}),
    h AS (SELECT row, col, arg_max(CAST(ord_stra AS DOUBLE), river_id) AS v FROM c JOIN {{v_river}} ON {INSIDE} GROUP BY 1, 2)
    SELECT row, col, coalesce(v, 0) AS value FROM c LEFT JOIN h USING (row, col)""")
def _(v):
    frame = centred(v).select("row", "col", "cx", "cy").distinct()
    polys = diamonds(v, 0.3507).join(v("v_river").select("river_id", "ord_stra"), "river_id")
    return grid.rasterize_polygons(frame, polys, 0.5, "ord_stra", "river_id")


@query("grd9_clip_cells", f"""
    SELECT tile, row, col, CASE WHEN EXISTS (SELECT 1 FROM {{v_river}} WHERE {INSIDE}) THEN value ELSE 0 END AS value FROM {CENTRED}""")
def _(v):
    return grid.clip_cells(centred(v), diamonds(v, 0.3507), 0.5).select("tile", "row", "col", "value")


@query("grd6_distance_grid", f"""
    WITH c AS (SELECT row, col, kind = 0 AND row % 3 = 0 AND value > 250 AS src FROM {{v_grid}}),
    s AS (SELECT row AS r, col AS c FROM c WHERE src),
    n AS (SELECT row, col, min(sqrt(pow(row - r, 2) + pow(col - c, 2))) AS px FROM c, s WHERE NOT src GROUP BY 1, 2)
    SELECT c.row, c.col, {q6("CASE WHEN src THEN 0 ELSE least(px * sqrt((900 + 1600) / 2.0), 500) END")} AS distance FROM c LEFT JOIN n USING (row, col)""")
def _(v):
    src = (F.col("kind") == 0) & (F.col("row") % 3 == 0) & (F.col("value") > 250)
    return rounded(grid.distance_grid(v("v_grid").withColumn("value", src.cast("int")), 30.0, 40.0, 500.0), "distance")


SOBEL = """
    WITH g AS (SELECT row, col, value, coalesce(lag(value) OVER r, value) AS l, coalesce(lead(value) OVER r, value) AS t FROM {v_grid} WINDOW r AS (PARTITION BY row ORDER BY col)),
    h AS (SELECT row, col, value, t - l AS dx, l + 2 * value + t AS sx FROM g),
    w AS (SELECT row, col, value, (coalesce(lag(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, dx)) / (8 * 30.0e0) AS gx,
                 (coalesce(lead(sx) OVER c, sx) - coalesce(lag(sx) OVER c, sx)) / (8 * 30.0e0) AS gy FROM h WINDOW c AS (PARTITION BY col ORDER BY row)),
    a AS (SELECT row, col, value, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (degrees(atan2(gy, gx)) + 90 + 360) % 360 AS aspect FROM w)"""


@query("grd7_slope_aspect", SOBEL + f" SELECT row, col, {q6('slope')} AS slope, {q6('aspect')} AS aspect FROM a")
def _(v):
    return rounded(grid.slope_aspect(v("v_grid"), 30.0), "slope", "aspect").select("row", "col", "slope", "aspect")


@query("grd8_hillshade", SOBEL + f""" SELECT row, col, {q6('''255 * (sin(radians(45)) * sin(radians(slope)) + cos(radians(45)) * cos(radians(slope))
    * cos(radians(315) - radians(aspect)) + 1) / 2''')} AS hillshade FROM a""")
def _(v):
    return rounded(grid.hillshade(v("v_grid"), res=30.0), "hillshade").select("row", "col", "hillshade")


@query("grd10_label_regions", """
    WITH RECURSIVE c AS (SELECT row, col, kind, CAST(row AS BIGINT) * 4294967296 + col AS id FROM {v_grid} WHERE kind IS NOT NULL),
    e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.kind = b.kind AND ((b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1))),
    w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    t AS (SELECT id AS node, id AS label FROM c UNION SELECT w.b, t.label FROM t JOIN w ON w.a = t.node WHERE t.label < w.b),
    l AS (SELECT node, min(label) AS region_id FROM t GROUP BY node)
    SELECT region_id, any_value(kind) AS value, count(*) AS n_cells, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max
    FROM l JOIN c ON c.id = l.node GROUP BY region_id""")
def _(v):
    """Regions of equal ``kind``, against a flood fill."""
    return comp.label_regions(v("v_grid"), 4, "kind")


SHAPE = (100, 140)


def water_points(v):
    return v("v_site").withColumn("water_score", (F.col("site_id") % 10 + 1) / 10.0)


@query("grd11_probability_discs", f"""
    WITH p AS (SELECT CAST(trunc((-5 - lat) / 10 * 99) AS INT) AS r, CAST(trunc((lon + 74) / 14 * 139) AS INT) AS c, max((site_id % 10 + 1) / 10.0e0) AS m FROM {{v_site}} GROUP BY 1, 2),
    k AS (SELECT i, j FROM range(-4, 5) a(i), range(-4, 5) b(j) WHERE i * i + j * j <= 16)
    SELECT CAST(r + i AS INT) AS row, CAST(c + j AS INT) AS col, {q6("max(m * exp(-0.5 * pow(sqrt(i * i + j * j) / 2, 2)))")} AS value FROM p, k
    WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 139 AND r + i BETWEEN 0 AND 99 AND c + j BETWEEN 0 AND 139 GROUP BY 1, 2""")
def _(v):
    return rounded(grid.probability_discs(water_points(v), SHAPE, (-74.0, -15.0, -60.0, -5.0), 4), "value")


def folded(at: str, size: int) -> str:
    """A place beyond the edge, mirrored back."""
    m = f"((({at}) % {2 * size}) + {2 * size}) % {2 * size}"
    return f"CAST(CASE WHEN {m} < {size} THEN {m} ELSE {2 * size - 1} - {m} END AS INT)"


@query("grd11_probability_grid", f"""
    WITH p AS (SELECT CAST(trunc((-5 - lat) / 10 * 99) AS INT) AS r, CAST(trunc((lon + 74) / 14 * 139) AS INT) AS c, max((site_id % 10 + 1) / 10.0e0) AS m FROM {{v_site}} GROUP BY 1, 2),
    o AS (SELECT i, j FROM range(-4, 5) a(i), range(-4, 5) b(j) WHERE i * i + j * j <= 16),
    d AS (SELECT r + i AS row, c + j AS col, max(m * exp(-0.5 * pow(sqrt(i * i + j * j) / 2, 2))) AS value FROM p, o
          WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 139 AND r + i BETWEEN 0 AND 99 AND c + j BETWEEN 0 AND 139 GROUP BY 1, 2),
    k AS (SELECT t, exp(-0.5 * pow(t * 3 / 4.0e0, 2)) / sum(exp(-0.5 * pow(t * 3 / 4.0e0, 2))) OVER () AS w FROM range(-5, 6) x(t)),
    a AS (SELECT {folded('row + t', 100)} AS row, col, sum(value * w) AS value FROM d, k GROUP BY 1, 2),
    b AS (SELECT row, {folded('col + t', 140)} AS col, sum(value * w) AS value FROM a, k GROUP BY 1, 2)
    SELECT row, CAST(col AS INT) AS col, {q6("value / max(value) OVER ()")} AS value FROM b""")
def _(v):
    """Smoothed and scaled discs; the filter is also checked against a dense computation in the tests."""
    return rounded(grid.probability_grid(water_points(v), SHAPE, (-74.0, -15.0, -60.0, -5.0), 4), "value")


TARGET = "CAST(floor(cy / 0.37e0) AS INT) AS row, CAST(floor(cx / 0.37e0) AS INT) AS col"
HOW = {"mean": q6("avg(value)"), "max": "max(value)", "min": "min(value)", "median": q6("quantile_cont(value, 0.5)"),
       "q1": q6("quantile_cont(value, 0.25)"), "q3": q6("quantile_cont(value, 0.75)")}


@query("grd12_resample", " UNION ALL ".join(
    f"SELECT '{h}' AS how, {TARGET}, {e} AS value FROM {CENTRED} WHERE value IS NOT NULL GROUP BY 2, 3" for h, e in HOW.items()) + f"""
    UNION ALL SELECT 'mode', row, col, value FROM (SELECT row, col, value, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) AS rn FROM (
        SELECT {TARGET}, value, count(*) AS n FROM {CENTRED} WHERE value IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1
    UNION ALL SELECT 'nearest', row, col, value FROM (SELECT row, col, value, row_number() OVER (PARTITION BY row, col ORDER BY
        round(sqrt(pow(cx - (col + 0.5e0) * 0.37e0, 2) + pow(cy - (row + 0.5e0) * 0.37e0, 2)), 9), cy, cx, value) AS rn FROM (SELECT {TARGET}, cx, cy, value FROM {CENTRED} WHERE value IS NOT NULL )) WHERE rn = 1""")
def _(v):
    c = centred(v)
    out = None
    for how in [*HOW, "mode", "nearest"]:
        part = grid.resample(c, 0.37, how).select(F.lit(how).alias("how"), "row", "col", r6("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("grd13_make_buffers", f"SELECT site_id, {d('2000')} AS radius_m, {q6('pi() * 4')} AS area_km2 FROM {{v_site}}")
def _(v):
    return rounded(comp.make_buffers(v("v_site"), 2.0), "area_km2").select("site_id", "radius_m", "area_km2")


@query("grd13_dissolved_buffers", f"""
    WITH RECURSIVE p AS (SELECT site_id AS id, {merc_x("lon")} AS x, {merc_y("lat")} AS y FROM {{v_site}}),
    e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 24000 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 24000),
    t AS (SELECT id AS a, id AS b FROM p UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
    SELECT a AS site_id, min(b) AS first_site FROM t GROUP BY a""")
def _(v):
    b = comp.make_buffers(v("v_site"), 12.0, dissolve=True)
    first = b.groupBy("group").agg(F.min("site_id").alias("first_site"))
    return b.join(first, "group").select("site_id", "first_site")


MEMBER_SPAN = "SELECT *, (max(value) OVER m - value) / (max(value) OVER m - min(value) OVER m) AS low FROM {v_member} WINDOW m AS (PARTITION BY member)"


@query("grd14_ensemble_cost", f"""
    WITH o AS (SELECT row, col, value / 10 AS dem, kind / 4.0e0 AS water, (kind * 7 % 5) / 4.0e0 AS prob FROM {{v_grid}}),
    e AS (SELECT member, sqrt(avg(pow(value - dem, 2))) AS dem_error, sum(least(low * low, water)) / (sum(greatest(low * low, water)) + 1e-10) AS iou,
                 avg(abs(pow(low, 1.5) - prob)) AS difference FROM ({MEMBER_SPAN}) JOIN o USING (row, col) GROUP BY member)
    SELECT member, {q6("dem_error")} AS dem_error, {q6("iou")} AS iou, {q6("difference")} AS difference,
           {q6("0.4 * dem_error + 0.3 * (1 - iou) + 0.3 * difference")} AS cost FROM e""")
def _(v):
    return round_all(grid.ensemble_cost(v("v_member"), observed(v)))


def observed(v):
    k = F.col("kind")
    return v("v_grid").select("row", "col", (F.col("value") / 10).alias("dem"), (k / 4.0).alias("water"), (k * 7 % 5 / 4.0).alias("prob"))


@query("grd14_best_member", f"""
    WITH o AS (SELECT row, col, value / 10 AS dem, kind / 4.0e0 AS water, (kind * 7 % 5) / 4.0e0 AS prob FROM {{v_grid}})
    SELECT member FROM ({MEMBER_SPAN}) JOIN o USING (row, col) GROUP BY member ORDER BY 0.4 * sqrt(avg(pow(value - dem, 2)))
      + 0.3 * (1 - sum(least(low * low, water)) / (sum(greatest(low * low, water)) + 1e-10)) + 0.3 * avg(abs(pow(low, 1.5) - prob)) LIMIT 1""")
def _(v):
    return grid.best_member(grid.ensemble_cost(v("v_member"), observed(v))).select("member")


EXC = f"SELECT row, col, avg(CASE WHEN low > 0.7 THEN 1 ELSE 0 END) AS probability FROM ({MEMBER_SPAN}) GROUP BY row, col"


@query("grd15_exceedance", f"SELECT row, col, {q6('probability')} AS probability, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS flag FROM ({EXC})")
def _(v):
    return rounded(grid.threshold_map(grid.exceedance(v("v_member"), 0.7), 0.5), "probability")


def long_members(v):
    """Line items as an ensemble over time: one step per return flag."""
    li = v("lineitem")
    t = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.groupBy(F.col("l_linenumber").alias("member"), t.alias("t"), F.floor(F.col("l_orderkey") / 150).cast("int").alias("row"),
                      (F.col("l_orderkey") % 150).cast("int").alias("col")).agg(F.sum("l_quantity").alias("value"))


SLICE = """
    WITH m AS (SELECT l_linenumber AS member, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t, CAST(floor(l_orderkey / 150.0e0) AS INT) AS row,
                      CAST(l_orderkey % 150 AS INT) AS col, sum(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2, 3, 4)"""


@query("grd16_ensemble_mean", SLICE + f" SELECT row, col, {q6('avg(value)')} AS value FROM m WHERE t = 1 GROUP BY 1, 2")
def _(v):
    return rounded(grid.ensemble_slice(long_members(v), 1), "value")


@query("grd16_ensemble_member", SLICE + " SELECT row, col, value FROM m WHERE t = 2 AND member = 3")
def _(v):
    return grid.ensemble_slice(long_members(v), 2, 3)


# metres by the radii of curvature at the middle latitude: good to a centimetre over these distances
MID = "radians((a.lat + b.lat) / 2)"
ELLIPSOID = f"""sqrt(pow(radians(a.lat - b.lat) * 6335439.327 / pow(1 - 0.00669437999014 * pow(sin({MID}), 2), 1.5), 2)
    + pow(radians(a.lon - b.lon) * 6378137 * cos({MID}) / sqrt(1 - 0.00669437999014 * pow(sin({MID}), 2)), 2))"""
CLUSTERS = f"""
    WITH RECURSIVE e AS (SELECT a.site_id AS a, b.site_id AS b FROM {{v_site}} a JOIN {{v_site}} b ON abs(a.lat - b.lat) < 0.3 AND {ELLIPSOID} <= 28000),
    t AS (SELECT site_id AS a, site_id AS b FROM {{v_site}} UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
    m AS (SELECT a AS site_id, dense_rank() OVER (ORDER BY min(b)) - 1 AS cluster_id FROM t GROUP BY a)"""


@query("ml1_cluster_sites", CLUSTERS + " SELECT site_id, cluster_id FROM m")
def _(v):
    """Sites merged transitively within 28 km."""
    return comp.cluster_sites(v("v_site"), 28000.0).select("site_id", "cluster_id")


@query("ml1_merge_sites", CLUSTERS + f""" SELECT cluster_id, arg_min(site_name, site_id) || CASE WHEN count(*) > 1 THEN '_cluster' || CAST(cluster_id AS VARCHAR) ELSE '' END AS site_name,
    count(*) AS n_merged_sites, {q6("avg(lat)")} AS lat, {q6("avg(lon)")} AS lon, arg_min(culture_tag, site_id) AS culture_tag
    FROM m JOIN {{v_site}} USING (site_id) GROUP BY cluster_id""")
def _(v):
    m = comp.merge_sites(comp.cluster_sites(v("v_site"), 28000.0))
    return rounded(m, "lat", "lon").select("cluster_id", "site_name", "n_merged_sites", "lat", "lon", "culture_tag")


@query("ml1_cluster_members", CLUSTERS + " SELECT cluster_id, site_id AS ord, site_name AS original_name, lat, lon FROM m JOIN {v_site} USING (site_id)")
def _(v):
    return comp.cluster_members(comp.cluster_sites(v("v_site"), 28000.0))


@query("agg35_merge_summary", f"""
    WITH m AS (SELECT c_nationkey, count(*) AS n_merged_sites FROM {{customer}} GROUP BY 1)
    SELECT count(*) AS total_sites, count(*) FILTER (WHERE n_merged_sites > 1) AS merged_clusters, count(*) FILTER (WHERE n_merged_sites = 1) AS individual_sites,
           CAST(sum(n_merged_sites) AS BIGINT) AS total_original_sites, CAST(sum(n_merged_sites) - count(*) AS BIGINT) AS reduction_count,
           {q6("(sum(n_merged_sites) - count(*)) * 100.0e0 / sum(n_merged_sites)")} AS reduction_percentage FROM m""")
def _(v):
    merged = v("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_merged_sites"))
    return round_all(agg.merge_summary(merged))
