"""SQL texts shared by oracle queries."""

from __future__ import annotations

from toposcan.functions import geo
from toposcan.plans.views import d

PI = "pi()"


def merc_x(lon: str) -> str:
    return f"(CAST(6378137 AS DOUBLE) * radians({lon}))"


def merc_y(lat: str) -> str:
    return f"(CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + radians({lat}) / 2)))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(2 * {d('6371')} * atan2(sqrt({a}), sqrt(1 - {a})))"


def posmod(expr: str, n: str = "360") -> str:
    return f"((({expr}) % {d(n)} + {d(n)}) % {d(n)})"


def along(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    len2 = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    num = f"(({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1}))"
    return f"least(1.0e0, greatest(0.0e0, CASE WHEN {len2} = 0 THEN 0.0e0 ELSE {num} / {len2} END))"


def utm_select(inner: str, lon: str, lat: str, zone: str, e: str = "e", n: str = "n") -> str:
    """``inner`` plus easting and northing (southern hemisphere) by the transverse Mercator series."""
    k = repr(geo._E2N)
    a1, a2, a3 = (repr(a) for a in geo._ALPHA)
    scale = repr(geo.UTM_SCALE * geo._A)
    east = " + ".join(["_eta"] + [f"{d(a)} * cos({2*j} * _xi) * sinh({2*j} * _eta)" for j, a in enumerate((a1, a2, a3), 1)])
    north = " + ".join(["_xi"] + [f"{d(a)} * sin({2*j} * _xi) * cosh({2*j} * _eta)" for j, a in enumerate((a1, a2, a3), 1)])
    return f"""
        SELECT * EXCLUDE (_lam, _phi, _t, _xi, _eta), {d(scale)} * ({east}) + 500000 AS {e},
               {d(scale)} * ({north}) + 10000000 AS {n} FROM (
          SELECT *, atan2(_t, cos(_lam)) AS _xi, atanh(sin(_lam) / sqrt(1 + _t * _t)) AS _eta FROM (
            SELECT *, sinh(atanh(sin(_phi)) - {d(k)} * atanh({d(k)} * sin(_phi))) AS _t FROM (
              SELECT *, radians({lon} - (({zone}) * 6 - 183)) AS _lam, radians({lat}) AS _phi FROM ({inner}))))"""
