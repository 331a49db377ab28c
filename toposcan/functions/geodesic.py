"""Distance on the WGS84 ellipsoid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

A = 6378137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)


def inverse_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres along the geodesic by Vincenty's inverse formula, for whole arrays; nearly antipodal pairs keep the last iterate."""
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    el = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    lam = el.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
            sig = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * sl / np.where(sin_s == 0, 1.0, sin_s))
            cos2a = 1 - sin_a**2
            cos2m = np.where(cos2a == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2a == 0, 1.0, cos2a))
            c = FLAT / 16 * cos2a * (4 + FLAT * (4 - 3 * cos2a))
            new = el + (1 - c) * FLAT * sin_a * (sig + c * sin_s * (cos2m + c * cos_s * (2 * cos2m**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-13
            lam = new
            if done:
                break
        uu = cos2a * (A**2 - B**2) / B**2
        ka = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        kb = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        ds = kb * sin_s * (cos2m + kb / 4 * (cos_s * (2 * cos2m**2 - 1) - kb / 6 * cos2m * (4 * sin_s**2 - 3) * (4 * cos2m**2 - 3)))
    return B * ka * (sig - ds)


@F.pandas_udf(T.DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Column function of :func:`inverse_m`."""
    args = [s.to_numpy(dtype=float, na_value=np.nan) for s in (lat1, lon1, lat2, lon2)]
    return pd.Series(inverse_m(*args)) if len(lat1) else pd.Series([], dtype=float)
