"""Raster cells as rows: ``row, col, value`` (and ``x, y`` where they are needed)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from toposcan.operators import spatial
from toposcan.operators.ordered import quantiles


def create_grid(spark: SparkSession, bounds: tuple[float, float, float, float], res: float) -> DataFrame:
    """Boxes over west, south, east, north; ids run down the columns of boxes."""
    w, s, e, n = bounds
    nx, ny = math.ceil(round((e - w) / res, 9)), math.ceil(round((n - s) / res, 9))
    i, j = F.floor(F.col("grid_id") / ny), F.col("grid_id") % ny
    return spark.range(nx * ny).withColumnRenamed("id", "grid_id").select(
        "grid_id", (w + i * res).alias("minx"), (s + j * res).alias("miny"), (w + (i + 1) * res).alias("maxx"), (s + (j + 1) * res).alias("maxy"))


def grid_of(df: DataFrame, res: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Boxes over the extent of a table's points."""
    r = df.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    return create_grid(df.sparkSession, tuple(float(v) for v in r), res)


def cell_index(df: DataFrame, west: float, north: float, size: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``row`` (southwards from ``north``) and ``col`` of each point."""
    return df.withColumns({"row": F.floor((north - F.col(lat)) / size).cast("int"), "col": F.floor((F.col(lon) - west) / size).cast("int")})


def sample_points(points: DataFrame, cells: DataFrame, west: float, north: float, size: float, out: str = "occ_pct") -> DataFrame:
    """Mean of the cells (of all tiles) that hold the point; nothing or nodata gives 0."""
    means = cells.groupBy("row", "col").agg(F.avg("value").alias(out))
    d = cell_index(points, west, north, size).join(means, ["row", "col"], "left")
    return d.withColumn(out, F.coalesce(out, F.lit(0.0))).drop("row", "col")


def with_centres(cells: DataFrame, west: float, north: float, size: float) -> DataFrame:
    """Add the centre of each cell as ``cx, cy`` in degrees."""
    return cells.withColumns({"cx": west + (F.col("col") + 0.5) * size, "cy": north - (F.col("row") + 0.5) * size})


def buffer_stats(points: DataFrame, cells: DataFrame, west: float, north: float, size: float, radius_km: float = 1.0,
                 key: str = "site_id") -> DataFrame:
    """Mean, max, min and number of the cells whose centre lies within ``radius_km`` (EPSG:3857) of each point."""
    c = spatial.with_planar(with_centres(cells.filter(F.col("value").isNotNull()), west, north, size), lon="cx", lat="cy", x="x2", y="y2")
    # copies of a location share one circle
    places = spatial.with_planar(points.select("lon", "lat").distinct())
    hit = spatial.near_pairs(places, c.select("x2", "y2", "value"), radius_km * 1000.0)
    s = hit.groupBy("lon", "lat").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("value").alias("count"))
    d = points.select(key, "lon", "lat").join(s, ["lon", "lat"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return d.drop("lon", "lat")


def zonal_stats(cells: DataFrame, polys: DataFrame, key: str, size: float, x: str = "cx", y: str = "cy") -> DataFrame:
    """Statistics of the cells whose centre lies in each polygon (``ring``); the deviation is that of the population.

    Cells of the same centre (of several tiles) are summed up first, so a polygon meets a centre once. Squares are taken about
    the mean of all cells and about the mean of each centre, not about zero.
    """
    c = cells.filter(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    centre = c.groupBy(x, y).agg(F.count("value").alias("_n"), F.sum("value").alias("_s"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"),
                                 F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    middle = c.agg(F.avg("value").alias("m")).scalar()
    centre = centre.withColumn("_d", F.col("_mean") - middle).withColumns({
        "_sd": F.col("_n") * F.col("_d"), "_sq": F.col("_n") * (F.col("_var") + F.col("_d") * F.col("_d"))}).drop("_mean", "_var", "_d")
    inside = spatial.points_within(centre, polys.select(key, "ring"), size, x, y)
    s = inside.groupBy(key).agg(*[F.sum(k).alias(k) for k in ("_n", "_s", "_sd", "_sq")], F.min("_lo").alias("min"), F.max("_hi").alias("max"))
    var = F.col("_sq") / F.col("_n") - F.pow(F.col("_sd") / F.col("_n"), 2)
    return s.select(key, (F.col("_s") / F.col("_n")).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), "min", "max",
                    F.col("_s").alias("sum"), F.col("_n").alias("count"))


def rasterize_points(cells: DataFrame, points: DataFrame, west: float, north: float, size: float, value: str | None = None,
                     order: str = "ord", fill: float = 0.0) -> DataFrame:
    """Burn points into the frame ``cells`` (``row, col``): the last point by ``order`` wins, other cells get ``fill``."""
    v = F.col(value).cast("double") if value else F.lit(1.0)
    hit = cell_index(points, west, north, size).groupBy("row", "col").agg(F.max_by(v, order).alias("value"))
    return cells.select("row", "col").join(hit, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def rasterize_polygons(cells: DataFrame, polys: DataFrame, size: float, value: str, order: str = "ord", fill: float = 0.0) -> DataFrame:
    """Burn polygons into cells with centres ``cx, cy``; the last polygon wins."""
    frame = cells.select("row", "col", "cx", "cy")
    inside = spatial.points_within(frame, polys.select("ring", F.col(value).cast("double").alias("_v"), F.col(order).alias("_o")), size, "cx", "cy")
    hit = inside.groupBy("row", "col").agg(F.max_by("_v", "_o").alias("value"))
    return frame.select("row", "col").join(hit, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def clip_cells(cells: DataFrame, polys: DataFrame, size: float) -> DataFrame:
    """Cells with centres ``cx, cy``; those outside every polygon get 0. Tiles share their centres, which are looked up once."""
    frame = cells.select("row", "col", "cx", "cy").distinct()
    inside = spatial.points_within(frame, polys.select("ring").distinct(), size, "cx", "cy")
    mark = inside.select("row", "col").distinct().withColumn("_in", F.lit(True))
    d = cells.join(mark, ["row", "col"], "left")
    return d.withColumn("value", F.when(F.col("_in"), F.col("value")).otherwise(0.0)).drop("_in")


TILE = 128  # cells along a side of a tile


def _tile_squares(reach: int):
    """Square of the distance to the nearest source for the own cells of a tile; sources of other tiles come within ``reach`` of its edge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = TILE + 2 * reach
        row, col = ((pdf[c] - pdf[t] * TILE).to_numpy() for c, t in (("row", "_tr"), ("col", "_tc")))
        source = np.zeros((size, size), bool)
        has = pdf["sources"].to_numpy() > 0
        source[row[has] + reach, col[has] + reach] = True
        at, far = np.arange(size), 1e9
        left = np.maximum.accumulate(np.where(source, at, -far), axis=1)
        right = np.minimum.accumulate(np.where(source, at, far)[:, ::-1], axis=1)[:, ::-1]
        along = np.minimum(at - left, right - at)[:, reach : reach + TILE] ** 2  # within the row
        best = np.full((TILE, TILE), np.inf)
        for step in range(2 * reach + 1):
            np.minimum(best, along[step : step + TILE] + (step - reach) ** 2, out=best)
        own = pdf["own"].to_numpy()
        return pdf.loc[own, ["row", "col", "sources", "others", "unknown"]].assign(square=best[row[own], col[own]])

    return run


def _near_sources(cells: DataFrame, reach: int) -> DataFrame:
    """``row, col, sources, others, unknown, square`` of every place: its rows by value (> 0, <= 0, null) and the square of the distance to the nearest source.

    The square is right up to ``reach``; beyond, it is some larger number. Tiles are worked on one by one; only sources near an edge are copied to the
    tiles beyond it. Rows at one place are counted before they move.
    """
    count = lambda c: F.count_if(c).alias
    places = cells.groupBy(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).agg(
        count(F.col("value") > 0)("sources"), count(F.col("value") <= 0)("others"), count(F.col("value").isNull())("unknown"))
    margin = F.when(F.col("sources") > 0, reach).otherwise(0)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - margin) / TILE), F.floor((F.col(c) + margin) / TILE)))
    dealt = places.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col"))
    dealt = dealt.withColumn("own", (F.col("_tr") == F.floor(F.col("row") / TILE)) & (F.col("_tc") == F.floor(F.col("col") / TILE)))
    return dealt.groupBy("_tr", "_tc").applyInPandas(
        _tile_squares(reach), "row BIGINT, col BIGINT, sources BIGINT, others BIGINT, unknown BIGINT, square DOUBLE")


def distance_grid(cells: DataFrame, width: float, height: float, max_dist: float | None = None) -> DataFrame:
    """Distance of every cell to the nearest source cell (value > 0), by the mean pixel size ``sqrt((w^2 + h^2) / 2)``.

    With a ``max_dist`` of up to ``TILE`` pixels, tiles are worked on with the sources about them; otherwise the nearest source is searched.
    """
    pixel = math.sqrt((width**2 + height**2) / 2)
    types = [cells.schema[c].dataType for c in ("row", "col")]
    if max_dist is not None and 0 <= max_dist <= TILE * pixel and all(isinstance(t, T.IntegralType) for t in types):
        most = F.lit(float(max_dist))
        placed = F.col("row").isNotNull() & F.col("col").isNotNull()
        near = _near_sources(cells.filter(placed), math.ceil(max_dist / pixel))
        dist = F.least(F.sqrt("square") * pixel, most)
        each = F.concat(F.array_repeat(F.lit(0.0), F.col("sources").cast("int")), F.array_repeat(dist, F.col("others").cast("int")),
                        F.array_repeat(F.when(F.col("others") > 0, dist).otherwise(most), F.col("unknown").cast("int")))
        near = near.select(*[F.col(c).cast(t).alias(c) for c, t in zip(("row", "col"), types)], F.explode(each).alias("distance"))
        return near.unionByName(cells.filter(~placed).select("row", "col", F.when(F.col("value") > 0, 0.0).otherwise(most).alias("distance")))
    p = cells.select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "value")
    near = spatial.nearest_distance(p.filter(F.col("value") <= 0), spatial.as_segments(p.filter(F.col("value") > 0)))
    d = p.join(near, ["x", "y"], "left").withColumn("distance", F.when(F.col("value") > 0, 0.0).otherwise(F.col("dist") * pixel))
    if max_dist is not None:
        d = d.withColumn("distance", F.least("distance", F.lit(float(max_dist))))
    return d.select("row", "col", "distance")


def _neighbour(col: str, step: int, w, axis: str) -> Column:
    """Value of the adjoining cell along an axis; at an edge (or a hole) the cell itself."""
    f = F.lag if step < 0 else F.lead
    there = f(axis, 1).over(w) == F.col(axis) + step
    return F.when(there, f(col, 1).over(w)).otherwise(F.col(col))


def slope_aspect(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Add ``slope`` and ``aspect`` (degrees) by the Sobel operator with reflected edges.

    The operator is separable, so two window passes do: along the rows, then along the columns. Cells move
    twice instead of being copied to nine neighbours.
    """
    w = Window.partitionBy("row").orderBy("col")
    left, right = _neighbour("value", -1, w, "col"), _neighbour("value", 1, w, "col")
    d = cells.withColumns({"_dx": right - left, "_sx": left + 2 * F.col("value") + right})
    w = Window.partitionBy("col").orderBy("row")
    up = lambda c: _neighbour(c, -1, w, "row")
    down = lambda c: _neighbour(c, 1, w, "row")
    d = d.withColumns({"_gx": (up("_dx") + 2 * F.col("_dx") + down("_dx")) / (8.0 * res), "_gy": (down("_sx") - up("_sx")) / (8.0 * res)})
    d = d.withColumns({"slope": F.degrees(F.atan(F.hypot("_gx", "_gy"))),
                       "aspect": F.pmod(F.degrees(F.atan2("_gy", "_gx")) + 90.0, F.lit(360.0))})
    return d.drop("_dx", "_sx", "_gx", "_gy")


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, res: float = 1.0, standard: bool = False) -> DataFrame:
    """Add ``hillshade``, scaled so that -1..1 becomes 0..255. The default swaps the slope terms as the known outputs do; ``standard`` is the usual formula."""
    d = slope_aspect(cells, res)
    slope, aspect = F.radians("slope"), F.radians("aspect")
    az, alt = math.radians(azimuth), math.radians(altitude)
    facing = F.cos(F.lit(az) - aspect)
    if standard:
        shade = math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * facing
    else:
        shade = math.sin(alt) * F.sin(slope) + math.cos(alt) * F.cos(slope) * facing
    return d.withColumn("hillshade", 255.0 * (shade + 1.0) / 2.0)


def probability_discs(points: DataFrame, shape: tuple[int, int], bounds: tuple[float, float, float, float], radius: int = 10,
                      weight: str = "water_score") -> DataFrame:
    """Gaussian disc (sigma radius / 2) of height ``weight`` around the cell of each point, the largest value per cell.

    Points are reduced to distinct cells before the discs are spread.
    """
    rows, cols = shape
    w, s, e, n = bounds
    cells = points.select(
        ((n - F.col("lat")) / (n - s) * (rows - 1)).cast("int").alias("r"), ((F.col("lon") - w) / (e - w) * (cols - 1)).cast("int").alias("c"), weight)
    cells = cells.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).groupBy("r", "c").agg(F.max(weight).alias("m"))
    disc = [(i, j, math.exp(-0.5 * (math.hypot(i, j) / (radius / 2)) ** 2)) for i in range(-radius, radius + 1)
            for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    step = F.inline(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(p).alias("p")) for i, j, p in disc]))
    d = cells.select("r", "c", "m", step)
    d = d.select((F.col("r") + F.col("di")).alias("row"), (F.col("c") + F.col("dj")).alias("col"), (F.col("m") * F.col("p")).alias("p"))
    d = d.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return d.groupBy("row", "col").agg(F.max("p").alias("value"))


def gaussian_smooth(cells: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    """Separable Gaussian filter (cut at four sigma, reflected edges) of a sparse grid; absent cells are 0."""
    reach = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    kernel = [k / sum(kernel) for k in kernel]
    step = F.inline(F.array(*[F.struct(F.lit(i - reach).alias("d"), F.lit(k).alias("k")) for i, k in enumerate(kernel)]))
    for axis, size in (("row", shape[0]), ("col", shape[1])):
        other = "col" if axis == "row" else "row"
        at = F.col(axis) + F.col("d")
        # a cell reaches beyond the edge and is mirrored back; the mirror image of -1 is 0
        folded = F.pmod(at, F.lit(2 * size))
        folded = F.when(folded < size, folded).otherwise(2 * size - 1 - folded)
        cells = cells.select(axis, other, "value", step).select(folded.cast("int").alias(axis), other, (F.col("value") * F.col("k")).alias("value"))
        cells = cells.groupBy("row", "col").agg(F.sum("value").alias("value"))
    return cells


def probability_grid(points: DataFrame, shape: tuple[int, int], bounds: tuple[float, float, float, float], radius: int = 10) -> DataFrame:
    """Discs, smoothed with sigma radius / 3 and scaled to a maximum of 1."""
    d = gaussian_smooth(probability_discs(points, shape, bounds, radius), shape, radius / 3)
    top = d.agg(F.max("value")).scalar()
    return d.withColumn("value", F.coalesce(F.try_divide(F.col("value"), top), F.lit(0.0)))


QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def resample(cells: DataFrame, target_size: float, how: str = "mean") -> DataFrame:
    """Cells with centres ``cx, cy`` onto a grid of ``target_size``: mean, mode, max, min, median, q1, q3 or nearest."""
    d = cells.filter(F.col("value").isNotNull()).withColumns({
        "row": F.floor(F.col("cy") / target_size).cast("int"), "col": F.floor(F.col("cx") / target_size).cast("int")})
    if how == "nearest":
        off = F.hypot(F.col("cx") - (F.col("col") + 0.5) * target_size, F.col("cy") - (F.col("row") + 0.5) * target_size)
        return d.groupBy("row", "col").agg(F.min_by("value", F.struct(F.round(off, 9).alias("d"), "cy", "cx", "value")).alias("value"))
    if how == "mode":
        n = d.groupBy("row", "col", "value").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("row", "col").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("value"))
    if how in QUANTILES:
        return quantiles(d, "value", {"value": QUANTILES[how]}, ["row", "col"])
    agg = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    return d.groupBy("row", "col").agg(agg("value").alias("value"))


def _lowness(members: DataFrame) -> DataFrame:
    """Add ``low``: 1 at the lowest and 0 at the highest cell of the member."""
    span = members.groupBy("member").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    low = F.coalesce(F.try_divide(F.col("_hi") - F.col("value"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return members.join(span, "member").withColumn("low", low).drop("_lo", "_hi")


def ensemble_cost(members: DataFrame, observed: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Cost of each elevation member against ``row, col, dem, water, prob``.

    Low cells are expected to be water (lowness squared) and to carry water names (lowness to the power 1.5): RMSE of the
    elevation, 1 - soft IoU with the water history, mean absolute difference to the name probability.
    """
    a, b, c = weights
    d = _lowness(members).join(observed, ["row", "col"]).withColumn("_w", F.col("low") * F.col("low"))
    d = d.groupBy("member").agg(
        F.sqrt(F.avg(F.pow(F.col("value") - F.col("dem"), 2))).alias("dem_error"),
        (F.sum(F.least("_w", "water")) / (F.sum(F.greatest("_w", "water")) + 1e-10)).alias("iou"),
        F.avg(F.abs(F.pow("low", F.lit(1.5)) - F.col("prob"))).alias("difference"))
    return d.withColumn("cost", a * F.col("dem_error") + b * (1.0 - F.col("iou")) + c * F.col("difference"))


def best_member(costs: DataFrame) -> DataFrame:
    return costs.orderBy("cost", "member").limit(1)


def exceedance(members: DataFrame, t: float = 0.7) -> DataFrame:
    """Share of the members in which a cell is low (lowness above ``t``)."""
    return _lowness(members).groupBy("row", "col").agg(F.avg((F.col("low") > t).cast("double")).alias("probability"))


def threshold_map(df: DataFrame, t: float = 0.5, col: str = "probability") -> DataFrame:
    return df.withColumn("flag", F.when(F.col(col) >= t, 1).otherwise(0))


def ensemble_slice(df: DataFrame, t: int, member: int | None = None) -> DataFrame:
    """Cells at a time index: of one member, or the mean over members."""
    d = df.filter(F.col("t") == t)
    if member is not None:
        return d.filter(F.col("member") == member).select("row", "col", "value")
    return d.groupBy("row", "col").agg(F.avg("value").alias("value"))
