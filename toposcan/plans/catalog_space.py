"""Projections, distances and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.functions import geo
from toposcan.operators import spatial
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.sqltext import along, haversine, merc_x, merc_y, posmod, utm_select


@query("prj9_web_mercator", f"SELECT feature_id, {q6(merc_x('lon'), 4)} AS x, {q6(merc_y('lat'), 4)} AS y FROM {{v_feature}}")
def _(v):
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    return v("v_feature").select("feature_id", r6(x, 4).alias("x"), r6(y, 4).alias("y"))


@query("prj10_utm", f"""
    SELECT feature_id, CAST(32700 + zone AS INT) AS epsg, {q6("e", 3)} AS e, {q6("n", 3)} AS n FROM (
    {utm_select("SELECT *, CAST(floor((lon + 180) / 6) AS INT) + 1 AS zone FROM {v_feature}", "lon", "lat", "zone")})""")
def _(v):
    f = geo.with_utm(v("v_feature"), "lon", "lat")
    return f.select("feature_id", geo.utm_epsg(F.col("lon"), F.col("lat")).cast("int").alias("epsg"),
                                 r6("e", 3).alias("e"), r6("n", 3).alias("n"))


@query("prj11_haversine", f"SELECT river_id, {q6(haversine('y1', 'x1', 'y2', 'x2'))} AS km FROM {{v_river}}")
def _(v):
    return v("v_river").select("river_id", r6(geo.haversine_km(*[F.col(c) for c in ("y1", "x1", "y2", "x2")])).alias("km"))


@query("prj13_bearing", f"SELECT river_id, {q6(posmod('90 - degrees(atan2(y2 - y1, x2 - x1))'))} AS bearing FROM {{v_river}}")
def _(v):
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return v("v_river").select("river_id", r6(geo.bearing_deg(dx, dy)).alias("bearing"))


@query("prj14_polar_angle", f"""
    SELECT river_id, {q6(posmod('degrees(atan2(y2 - y1, x2 - x1)) - 90'))} AS north_cw,
           {q6(posmod('90 - degrees(atan2(y2 - y1, x2 - x1))'))} AS north_ccw,
           {q6(posmod('-degrees(atan2(y2 - y1, x2 - x1))'))} AS east_cw,
           {q6(posmod('degrees(atan2(y2 - y1, x2 - x1))'))} AS east_ccw FROM {{v_river}}""")
def _(v):
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return v("v_river").select("river_id", *[
        r6(geo.polar_angle(dx, dy, ref, way)).alias(name)
        for name, ref, way in [("north_cw", "north", "clockwise"), ("north_ccw", "north", "counterclockwise"),
                               ("east_cw", "east", "clockwise"), ("east_ccw", "east", "counterclockwise")]])


@query("prj16_bbox_around", f"""
    SELECT site_id, {q6("lon - 5 / (111.0e0 * cos(radians(lat)))")} AS lon_min, {q6("lat - 5 / 111.0e0")} AS lat_min,
           {q6("lon + 5 / (111.0e0 * cos(radians(lat)))")} AS lon_max, {q6("lat + 5 / 111.0e0")} AS lat_max FROM {{v_site}}""")
def _(v):
    box = geo.bbox_around(F.col("lat"), F.col("lon"), 5.0)
    return v("v_site").select("site_id", *[r6(c).alias(n) for n, c in box.items()])


# ---- nearest line --------------------------------------------------------------------------------

PLANAR_PAIRS = f"""
    SELECT feature_id, river_id, ord_stra, main_riv, sqrt(pow(px - (x1 + t * (x2 - x1)), 2) + pow(py - (y1 + t * (y2 - y1)), 2)) / 1000 AS km
    FROM (SELECT *, {along('px', 'py', 'x1', 'y1', 'x2', 'y2')} AS t FROM (
        SELECT feature_id, river_id, ord_stra, main_riv, {merc_x('f.lon')} AS px, {merc_y('f.lat')} AS py, {merc_x('r.x1')} AS x1,
               {merc_y('r.y1')} AS y1, {merc_x('r.x2')} AS x2, {merc_y('r.y2')} AS y2 FROM {{v_feature}} f, {{v_river}} r))"""


@query("jn1_attach_distance", f"SELECT feature_id, {q6('min(km)')} AS dist_km FROM ({PLANAR_PAIRS}) GROUP BY feature_id")
def _(v):
    return rounded(spatial.attach_distance(v("v_feature").select("feature_id", "lon", "lat"), v("v_river")), "dist_km").select(
        "feature_id", "dist_km")


@query("jn2_nearest_river", f"""
    SELECT feature_id, river_id, ord_stra, main_riv, {q6('km')} AS dist_km FROM (
      SELECT *, min(km) OVER (PARTITION BY feature_id) AS best FROM ({PLANAR_PAIRS})) WHERE km <= best + 1e-9""")
def _(v):
    near = spatial.nearest_river(v("v_feature").select("feature_id", "lon", "lat"), v("v_river"))
    return rounded(near, "dist_km").select("feature_id", "river_id", "ord_stra", "main_riv", "dist_km")


@query("jn3_river_polar", f"""
    WITH p AS (SELECT *, {along('lon', 'lat', 'x1', 'y1', 'x2', 'y2')} AS t FROM {{v_feature}}, {{v_river}}),
    q AS (SELECT feature_id, river_id, main_riv, lon, lat, x1 + t * (x2 - x1) AS nx, y1 + t * (y2 - y1) AS ny FROM p),
    k AS (SELECT *, {haversine('lat', 'lon', 'ny', 'nx')} AS km FROM q
          WHERE sqrt(pow(lon - nx, 2) + pow(lat - ny, 2)) <= 50 / 111.0e0),
    b AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY km, river_id) AS rn FROM k WHERE km <= 50)
    SELECT f.feature_id, {q6(posmod('90 - degrees(atan2(b.ny - b.lat, b.nx - b.lon))'))} AS river_angle,
           {q6('b.km')} AS river_radius, b.main_riv AS nearest_river
    FROM {{v_feature}} f LEFT JOIN b ON f.feature_id = b.feature_id AND b.rn = 1""")
def _(v):
    out = spatial.river_polar(v("v_feature").select("feature_id", "lon", "lat"), v("v_river"), 50.0)
    return rounded(out, "river_angle", "river_radius").select("feature_id", "river_angle", "river_radius", "nearest_river")


# ---- within a radius -----------------------------------------------------------------------------

AROUND_KM = 20.0
AROUND = f"""
    SELECT site_id, feature_id, sqrt(pow(te - se, 2) + pow(tn - sn, 2)) / 1000 AS km FROM (
    {utm_select(utm_select('''SELECT s.site_id, f.feature_id, s.lon AS slon, s.lat AS slat, f.lon AS flon, f.lat AS flat,
        CAST(floor((s.lon + 180) / 6) AS INT) + 1 AS zone FROM {v_site} s JOIN {v_feature} f
        ON abs(s.lon - f.lon) < 0.25 AND abs(s.lat - f.lat) < 0.25''', 'slon', 'slat', 'zone', 'se', 'sn'),
        'flon', 'flat', 'zone', 'te', 'tn')})"""


@query("jn4_toponyms_around", f"SELECT site_id, feature_id, {q6('km')} AS distance_km FROM ({AROUND}) WHERE km <= 20")
def _(v):
    near = spatial.toponyms_around(v("v_site").select("site_id", "lon", "lat"),
                                   v("v_feature").select("feature_id", "lon", "lat"), AROUND_KM, places=6)
    return near.select("site_id", "feature_id", "distance_km")


KNOWN_CAND = f"""
    SELECT site_id, cand_id, sqrt(pow(e1 - e2, 2) + pow(n1 - n2, 2)) AS m FROM (
    {utm_select(utm_select('''SELECT s.site_id, c.cand_id, s.lon AS slon, s.lat AS slat, c.lon AS clon, c.lat AS clat
        FROM {v_site} s JOIN {v_cand} c ON abs(s.lon - c.lon) < 0.01 AND abs(s.lat - c.lat) < 0.01''',
        'slon', 'slat', '21', 'e1', 'n1'), 'clon', 'clat', '21', 'e2', 'n2')})"""


@query("jn5_match_known", f"""
    SELECT site_id, cand_id, {q6('m', 3)} AS dist_m FROM (
      SELECT *, min(m) OVER (PARTITION BY site_id) AS best FROM ({KNOWN_CAND}) WHERE m <= 500) WHERE m <= best + 1e-6""")
def _(v):
    out = spatial.match_known(v("v_site").select("site_id", "lon", "lat"), v("v_cand").select("cand_id", "lon", "lat"), 500.0)
    return out.select("site_id", "cand_id", r6("dist_m", 3).alias("dist_m"))


HITS = f"SELECT DISTINCT cand_id FROM ({KNOWN_CAND}) WHERE m <= 500"


@query("jn6_is_hit", f"SELECT cand_id, cand_id IN ({HITS}) AS is_hit FROM {{v_cand}}")
def _(v):
    return spatial.is_hit(v("v_cand").select("cand_id", "lon", "lat"), v("v_site")).select("cand_id", "is_hit")


@query("smp7_false_positives", f"SELECT cand_id FROM {{v_cand}} WHERE cand_id NOT IN ({HITS})")
def _(v):
    return spatial.false_positives(v("v_cand").select("cand_id", "lon", "lat"), v("v_site")).select("cand_id")


@query("jn7_close_pairs", f"""
    SELECT a, b, {q6('m', 3)} AS dist_m FROM (SELECT a.site_id AS a, b.site_id AS b,
        {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000 AS m
        FROM {{v_site}} a JOIN {{v_site}} b ON a.site_id < b.site_id AND abs(a.lat - b.lat) < 0.3) WHERE m <= 30000""")
def _(v):
    return spatial.close_pairs(v("v_site"), 30000.0, places=3).select("a", "b", "dist_m")


@query("jn8_far_from", f"""
    SELECT feature_id FROM {{v_feature}} WHERE feature_id NOT IN (
      SELECT feature_id FROM {{v_feature}} f JOIN {{v_site}} s ON abs(f.lat - s.lat) < 0.2 AND
      sqrt(pow({merc_x('f.lon')} - {merc_x('s.lon')}, 2) + pow({merc_y('f.lat')} - {merc_y('s.lat')}, 2)) < 4000)""")
def _(v):
    return spatial.far_from(v("v_feature").select("feature_id", "lon", "lat"), v("v_site"), 4.0).select("feature_id")


@query("jn14_points_within_boxes", """
    SELECT feature_id, river_id FROM {v_feature} JOIN {v_river}
    ON lon > x1 - 0.4e0 AND lon < x1 + 0.4e0 AND lat > y1 - 0.3e0 AND lat < y1 + 0.3e0""")
def _(v):
    boxes = v("v_river").select("river_id", (F.col("x1") - 0.4).alias("minx"), (F.col("y1") - 0.3).alias("miny"),
                                (F.col("x1") + 0.4).alias("maxx"), (F.col("y1") + 0.3).alias("maxy"))
    return spatial.points_within_boxes(v("v_feature").select("feature_id", "lon", "lat"), boxes, 0.5).select("feature_id", "river_id")


def diamonds(v, radius: float):
    """One diamond-shaped polygon per river start."""
    x, y = F.col("x1"), F.col("y1")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(-radius, 0.0), corner(0.0, radius), corner(radius, 0.0), corner(0.0, -radius))
    return v("v_river").select("river_id", "x1", "y1", ring.alias("ring"))


@query("jn14_points_within", """
    SELECT feature_id, river_id FROM {v_feature} JOIN {v_river} ON abs(lon - x1) + abs(lat - y1) < 0.5003e0""")
def _(v):
    return spatial.points_within(v("v_feature").select("feature_id", "lon", "lat"), diamonds(v, 0.5003).select("river_id", "ring"), 0.5).select("feature_id", "river_id")


@query("jn15_spatial_confusion", f"""
    WITH k AS (SELECT count(*) AS tp FROM {{v_site}} s JOIN {{v_cand}} c ON abs(s.lon - c.lon) <= 0.011 AND abs(s.lat - c.lat) <= 0.011
               AND sqrt(pow(s.lon - c.lon, 2) + pow(s.lat - c.lat, 2)) <= 0.0105e0),
    n AS (SELECT tp, (SELECT count(*) FROM {{v_cand}}) - tp AS fp,
                 (SELECT count(*) FROM {{v_site}}) * (SELECT count(*) FROM {{v_cand}}) - tp AS fn FROM k)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {q6("tp / (tp + fp)", 9)} AS precision, {q6("tp / (tp + fn)", 9)} AS recall,
           {q6("2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))", 9)} AS f1 FROM n""")
def _(v):
    t = v("v_site").select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    p = v("v_cand").select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(spatial.spatial_confusion(t, p, 0.0105), "precision", "recall", "f1", places=9)
