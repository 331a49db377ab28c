"""Geometry as plain column arithmetic: projections, distances, bearings, WKT."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EARTH_KM = 6371.0
MERCATOR_R = 6378137.0
KM_PER_DEG = 111.0

# WGS84 ellipsoid and the Krueger series (third order in the third flattening).
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = MERCATOR_R / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_E2N = 2 * math.sqrt(_N) / (1 + _N)
UTM_SCALE = 0.9996


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres (EPSG:3857)."""
    x = F.lit(MERCATOR_R) * F.radians(lon)
    y = F.lit(MERCATOR_R) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return x, y


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 6.0).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the zone: 326xx north, 327xx south."""
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def conformal_t(lat: Column) -> Column:
    """Tangent of the conformal latitude: the part of the projection that depends on the latitude alone."""
    sin_phi = F.sin(F.radians(lat))
    return F.sinh(F.atanh(sin_phi) - F.lit(_E2N) * F.atanh(F.lit(_E2N) * sin_phi))


def gauss(lon: Column, t: Column, zone: Column | int) -> tuple[Column, Column]:
    """Coordinates (xi, eta) on the unit sphere's transverse cylinder of a UTM zone."""
    lam = F.radians(lon - ((F.lit(zone) if isinstance(zone, int) else zone) * 6.0 - 183.0))
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))


def utm_metres(xi: Column, eta: Column, south: Column | bool = True) -> tuple[Column, Column]:
    """Easting and northing from (xi, eta)."""
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        north = north + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    k = F.lit(UTM_SCALE * _A)
    south = F.lit(south) if isinstance(south, bool) else south
    return k * east + 500000.0, k * north + F.when(south, 10000000.0).otherwise(0.0)


def with_utm(df: DataFrame, lon: str, lat: str, zone: Column | int | None = None, south: Column | bool | None = None,
             e: str = "e", n: str = "n") -> DataFrame:
    """Add UTM easting and northing. Built in steps: as one expression the repeated parts would grow the plan."""
    zone = utm_zone(F.col(lon)) if zone is None else (F.lit(zone) if isinstance(zone, int) else zone)
    south = F.col(lat) < 0 if south is None else south
    d = df.withColumns({"_z": zone, "_t": conformal_t(F.col(lat))})
    xi, eta = gauss(F.col(lon), F.col("_t"), F.col("_z"))
    d = d.withColumns({"_xi": xi, "_eta": eta})
    east, north = utm_metres(F.col("_xi"), F.col("_eta"), south)
    return d.withColumns({e: east, n: north}).drop("_z", "_t", "_xi", "_eta")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def bearing_deg(dx: Column, dy: Column) -> Column:
    """North 0, clockwise, in degree space."""
    return F.pmod(90.0 - F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def polar_angle(dx: Column, dy: Column, reference: str = "north", direction: str = "clockwise",
                true_bearing: bool = False) -> Column:
    """Angle of (dx, dy). The default pair puts east at 270; ``true_bearing`` gives the compass angle."""
    if true_bearing:
        return bearing_deg(dx, dy)
    angle = F.degrees(F.atan2(dy, dx))
    if reference == "north":
        angle = F.lit(90.0) - angle
    if direction == "clockwise":
        angle = -angle
    return F.pmod(angle, F.lit(360.0))


def bbox_around(lat: Column, lon: Column, radius_km: Column | float) -> dict[str, Column]:
    dlat = F.lit(radius_km) / KM_PER_DEG
    dlon = F.lit(radius_km) / (F.cos(F.radians(lat)) * KM_PER_DEG)
    return {"lon_min": lon - dlon, "lat_min": lat - dlat, "lon_max": lon + dlon, "lat_max": lat + dlat}


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


WKT_POINT = r"POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)"


def wkt_lon(col: Column) -> Column:
    return F.regexp_extract(col, WKT_POINT, 1).try_cast("double")


def wkt_lat(col: Column) -> Column:
    return F.regexp_extract(col, WKT_POINT, 2).try_cast("double")


def to_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def _along(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, len2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def segment_nearest(px, py, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Point of a segment nearest to (px, py)."""
    t = _along(px, py, x1, y1, x2, y2)
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    nx, ny = segment_nearest(px, py, x1, y1, x2, y2)
    return F.sqrt(F.pow(px - nx, 2) + F.pow(py - ny, 2))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against ``array<struct<x,y>>`` (open or closed ring)."""
    closing = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), closing.alias("b"))

    def crosses(e: Column) -> Column:
        ax, ay = e["a"]["x"], e["a"]["y"]
        bx, by = e["b"]["x"], e["b"]["y"]
        straddles = (ay > y) != (by > y)
        return straddles & (x < F.try_divide((bx - ax) * (y - ay), by - ay) + ax)

    return F.size(F.filter(edges, crosses)) % 2 == 1
