"""Spatial joins on plain columns.

Three kernels serve all of them.

* ``near_pairs``: all pairs within a radius. Left rows are copied to the grid
  cells their circle touches, right rows sit in one cell, and the cell key is an
  ordinary equi-join key. The result is as large as the answer.
* ``meet``: the same for sides with many rows at one place. Each distinct place
  (point, box, ring) carries its rows in packs, places are compared once, and
  the pairs of rows are written out where two packs have met.
* ``nearest``: nearest line segment or point. Both sides are reduced to the
  distinct grid cells they occupy, and *cells* are compared level by level, from
  one root cell down to small leaf cells. A cell pair survives while its
  smallest possible distance does not exceed the largest possible distance to
  some occupied cell. Only survivors reach the exact distance, so neither a
  crowded cell nor an empty region makes a point look at many segments, and
  copies of one location are looked up once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.functions import geo
from toposcan.operators.ordered import largest_group
from toposcan.session import cut

LEAF_ROWS = 128  # aim for the number of segments in the fullest leaf cell
MAX_LEVELS = 12
SEG = ["x1", "y1", "x2", "y2"]


def _grid(points: DataFrame, segs: DataFrame) -> tuple[float, float, float, int] | None:
    """Origin, leaf size and number of levels, from one-row statistics."""
    p = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    lo_x, hi_x = F.least("x1", "x2"), F.greatest("x1", "x2")
    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    s = segs.agg(
        F.min(lo_x), F.min(lo_y), F.max(hi_x), F.max(hi_y), F.count(F.lit(1)),
        F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))),
    ).first()
    if p[0] is None or s[0] is None:
        return None
    x0, y0 = min(p[0], s[0]), min(p[1], s[1])
    extent = max(max(p[2], s[2]) - x0, max(p[3], s[3]) - y0, 1e-9) * 1.0001
    n, mean_len = s[4], s[5]
    # About 2 segments per cell if they were spread evenly, but not far below their own length.
    even = max(extent * math.sqrt(2.0 / n), mean_len / 4, extent / 4**MAX_LEVELS)
    levels = max(0, min(MAX_LEVELS, math.ceil(math.log(extent / even, 4))))
    # Crowded places need smaller leaves: fullest cell per level, one pass over midpoints.
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    sizes = F.explode(F.array(*[F.lit(i) for i in range(levels, MAX_LEVELS + 1)])).alias("lvl")
    full = {
        r["lvl"]: r["m"]
        for r in segs.select(sizes, mx.alias("mx"), my.alias("my"))
        .withColumn("w", F.lit(extent) / F.pow(F.lit(4.0), F.col("lvl")))
        .groupBy("lvl", F.floor((F.col("mx") - x0) / F.col("w")), F.floor((F.col("my") - y0) / F.col("w")))
        .count()
        .groupBy("lvl").agg(F.max("count").alias("m"))
        .collect()  # at most MAX_LEVELS + 1 rows
    }
    floor_lvl = max(levels, int(math.log(max(extent / max(mean_len / 16, extent / 4**MAX_LEVELS), 1), 4)))
    while levels < floor_lvl and full.get(levels, 0) > LEAF_ROWS:
        levels += 1
    return x0, y0, extent / 4**levels, levels


def _up(col: str) -> Column:
    """Cell index one level up: 4 x 4 cells share a parent."""
    return F.shiftright(F.col(col), 2)


#: A factor, or one as a function of the distance from the equator (|y|) that grows with it.
Slack = float | Callable[[Column], Column]


def _factor(slack: Slack, y: Column) -> Column:
    return slack(y) if callable(slack) else F.lit(float(slack))


def _candidates(points: DataFrame, segs: DataFrame, max_dist: float | None, slack: Slack) -> DataFrame:
    """``x, y, x1, y1, x2, y2, dist`` for the segments that may be nearest to a point, as far as their cells tell."""
    # Rows without coordinates fall out by themselves: their distance is null. The distinct locations are read several
    # times below; cut here, their projection and the shuffle that makes them distinct run once.
    points = cut(points.select("x", "y").distinct())
    segs = cut(segs.select(*SEG).distinct())
    grid = _grid(points, segs)
    if grid is None:
        return points.withColumns({c: F.lit(None).cast("double") for c in [*SEG, "dist"]}).limit(0)
    x0, y0, w, levels = grid
    top = 4**levels - 1

    def cell(c: Column, o: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((c - o) / w))).cast("bigint")

    pts = points.withColumns({"qx": cell(F.col("x"), x0), "qy": cell(F.col("y"), y0)})
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / w))
    pad = w * 1e-6
    pieces = segs.withColumn("n", steps.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("n"))
    ax, ay = at("x1", "x2", F.col("i")), at("y1", "y2", F.col("i"))
    bx, by = at("x1", "x2", F.col("i") + 1), at("y1", "y2", F.col("i") + 1)
    pieces = pieces.select(
        *SEG,
        F.explode(F.sequence(cell(F.least(ax, bx) - pad, x0), cell(F.greatest(ax, bx) + pad, x0))).alias("sx"),
        F.least(ay, by).alias("ly"), F.greatest(ay, by).alias("hy"),
        cell(ax, x0).alias("cx"), cell(ay, y0).alias("cy"),
    )
    cover = pieces.select(
        *SEG, "sx", F.explode(F.sequence(cell(F.col("ly") - pad, y0), cell(F.col("hy") + pad, y0))).alias("sy"),
        "cx", "cy",
    )
    # A padded or corner cell may hold nothing of the segment: it can be searched, but gives no bound.
    cover = cover.groupBy(*SEG, "sx", "sy").agg(
        F.max((F.col("sx") == F.col("cx")) & (F.col("sy") == F.col("cy"))).alias("sure")
    )
    q_cells = pts.select("qx", "qy").distinct()
    if levels > 1:
        cover = cut(cover)
    q_at, s_at = [q_cells], [cover.groupBy("sx", "sy").agg(F.max("sure").alias("sure"))]
    for _ in range(1, levels):
        q_at.append(q_at[-1].select(_up("qx").alias("qx"), _up("qy").alias("qy")).distinct())
        s_at.append(s_at[-1].groupBy(_up("sx").alias("sx"), _up("sy").alias("sy")).agg(F.max("sure").alias("sure")))

    # the root is one cell on either side; read from the data so that it stays an equi-join key
    zero = F.shiftright(F.min("qx"), 62)
    pairs = q_cells.agg(*[zero.alias(c) for c in ("qx", "qy", "sx", "sy")])
    for lvl in range(levels - 1, -1, -1):
        width = w * 4**lvl
        q = q_at[lvl].withColumns({"pqx": _up("qx"), "pqy": _up("qy")})
        s = s_at[lvl].withColumns({"psx": _up("sx"), "psy": _up("sy")})
        up = pairs.select(F.col("qx").alias("pqx"), F.col("qy").alias("pqy"),
                          F.col("sx").alias("psx"), F.col("sy").alias("psy"))
        found = up.join(q, ["pqx", "pqy"]).join(s, ["psx", "psy"])
        gap = lambda a, b: F.abs(F.col(a) - F.col(b)).cast("double")
        gx, gy = gap("qx", "sx"), gap("qy", "sy")
        near = F.hypot(F.greatest(gx - 1, F.lit(0.0)), F.greatest(gy - 1, F.lit(0.0))) * (width * (1 - 1e-9))
        edge = F.greatest(*[F.abs(y0 + (F.col("qy") + k) * width) for k in (0, 1)])  # a cell allows for its own rows, not for the table's
        far = F.hypot(gx + 1, gy + 1) * (width * (1 + 1e-9)) * _factor(slack, edge)
        found = found.select("qx", "qy", "sx", "sy", near.alias("near"), F.when(F.col("sure"), far).alias("far"))
        if max_dist is not None:
            found = found.filter(F.col("near") <= max_dist)
        bound = F.min("far").over(Window.partitionBy("qx", "qy"))
        pairs = (
            found.withColumn("bound", bound)
            .filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
            .select("qx", "qy", "sx", "sy")
        )

    dist = geo.segment_distance(*[F.col(c) for c in ["x", "y", *SEG]])
    cand = pts.join(pairs, ["qx", "qy"]).join(cover.select(*SEG, "sx", "sy"), ["sx", "sy"])
    return cand.select("x", "y", *SEG, dist.alias("dist"))


def nearest(points: DataFrame, segs: DataFrame, max_dist: float | None = None, slack: Slack = 1.0) -> DataFrame:
    """Nearest segments of every distinct point.

    ``points`` has ``x, y``; ``segs`` has ``x1, y1, x2, y2`` (a point is a segment
    of length zero). Returns ``x, y, x1, y1, x2, y2, dist`` for all segments with
    ``dist <= slack * smallest dist``; with ``slack`` 1 these are the nearest and
    its exact ties. ``max_dist`` drops what lies farther.
    """
    cand = _candidates(points, segs, max_dist, slack)
    best = F.min("dist").over(Window.partitionBy("x", "y"))
    kept = F.col("dist") <= F.col("_b") * _factor(slack, F.abs(F.col("y")))
    if max_dist is not None:
        kept = kept & (F.col("dist") <= max_dist)
    return cand.withColumn("_b", best).filter(kept).drop("_b").distinct()


def nearest_distance(points: DataFrame, segs: DataFrame, max_dist: float | None = None) -> DataFrame:
    """``x, y, dist`` for every distinct point that has a segment in reach. Candidates are reduced before the shuffle."""
    near = _candidates(points, segs, max_dist, 1.0).groupBy("x", "y").agg(F.min("dist").alias("dist"))
    return near.filter(F.col("dist").isNotNull() if max_dist is None else F.col("dist") <= max_dist)


def as_segments(df: DataFrame) -> DataFrame:
    return df.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def with_planar(df: DataFrame, project: str = "mercator", lon: str = "lon", lat: str = "lat",
                x: str = "x", y: str = "y") -> DataFrame:
    """Add planar columns: ``mercator`` (EPSG:3857), ``utm21s`` (EPSG:32721) or ``degree``."""
    if project == "mercator":
        px, py = geo.web_mercator(F.col(lon), F.col(lat))
    elif project == "utm21s":
        return geo.with_utm(df, lon, lat, zone=21, south=True, e=x, n=y)
    else:
        px, py = F.col(lon), F.col(lat)
    return df.withColumns({x: px, y: py})


def planar_segments(segs: DataFrame) -> DataFrame:
    """Project ``x1..y2`` in degrees to EPSG:3857, other columns kept."""
    out = with_planar(segs, "mercator", "x1", "y1", "_ax", "_ay")
    out = with_planar(out, "mercator", "x2", "y2", "_bx", "_by")
    keep = [c for c in segs.columns if c not in SEG]
    return out.select(*keep, F.col("_ax").alias("x1"), F.col("_ay").alias("y1"),
                      F.col("_bx").alias("x2"), F.col("_by").alias("y2"))


def attach_distance(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Distance in km (planar EPSG:3857) to the nearest segment, as ``dist_km``."""
    p = with_planar(points)
    near = nearest_distance(p, planar_segments(segments))
    out = p.join(near, ["x", "y"], "left").withColumn("dist_km", F.col("dist") / 1000.0)
    return out.select(*points.columns, "dist_km")


def nearest_river(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Nearest segment with its attributes; equal distances keep all rows."""
    p = with_planar(points)
    s = planar_segments(segments)
    near = nearest(p, s)
    attrs = [c for c in s.columns if c not in SEG]
    hits = near.join(s, SEG).select("x", "y", *attrs, (F.col("dist") / 1000.0).alias("dist_km")).distinct()
    return p.join(hits, ["x", "y"], "left").select(*points.columns, *attrs, "dist_km")


def river_polar(points: DataFrame, segments: DataFrame, max_km: float = 50.0, name: str = "main_riv") -> DataFrame:
    """Angle, km and name of the nearest river within ``max_km``; nulls where there is none.

    Per river the nearest point in degree space counts, and rivers are compared by
    haversine to that point. A river that wins by haversine is at most
    ``1 / cos(lat)`` times as far in degrees as the planar nearest one; that holds for each row by its own latitude.
    """
    p = with_planar(points, "degree")
    reach = max_km / geo.KM_PER_DEG
    stretch = lambda y: 1.01 / F.greatest(F.cos(F.radians(F.least(y + 2 * reach, F.lit(89.0)))), F.lit(0.01))
    near = nearest(p, segments, max_dist=reach, slack=stretch)
    nx, ny = geo.segment_nearest(*[F.col(c) for c in ["x", "y", *SEG]])
    named = segments.select(*SEG, "river_id", F.col(name).alias("river_name"))
    on_line = near.join(named, SEG).withColumns({"nx": nx, "ny": ny})
    per_river = on_line.groupBy("x", "y", "river_id").agg(
        F.min_by(F.struct("nx", "ny", "river_name"), F.struct("dist", "nx", "ny")).alias("p")
    )
    per_river = per_river.select("x", "y", "river_id", "p.*")
    km = geo.haversine_km(F.col("y"), F.col("x"), F.col("ny"), F.col("nx"))
    best = (
        per_river.withColumn("km", km)
        .filter(F.col("km") <= max_km)
        .groupBy("x", "y")
        .agg(F.min_by(F.struct("nx", "ny", "km", "river_name"), F.struct("km", "river_id")).alias("b"))
        .select(
            "x", "y",
            geo.bearing_deg(F.col("b.nx") - F.col("x"), F.col("b.ny") - F.col("y")).alias("river_angle"),
            F.col("b.km").alias("river_radius"),
            F.col("b.river_name").alias("nearest_river"),
        )
    )
    return p.join(best, ["x", "y"], "left").select(*points.columns, "river_angle", "river_radius", "nearest_river")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y",
               rx: str = "x2", ry: str = "y2") -> DataFrame:
    """All planar pairs within ``radius`` with their ``dist``; column names of both sides must differ."""
    around = lambda c: F.explode(F.sequence(
        F.floor((F.col(c) - radius) / radius), F.floor((F.col(c) + radius) / radius)))
    a = left.withColumn("_cx", around(lx)).withColumn("_cy", around(ly))
    b = right.withColumns({"_cx": F.floor(F.col(rx) / radius), "_cy": F.floor(F.col(ry) / radius)})
    d = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    return a.join(b, ["_cx", "_cy"]).withColumn("dist", d).filter(F.col("dist") <= radius).drop("_cx", "_cy")


PACK_ROWS = 1024  # rows of one place that travel together
PAIR_ROWS = 64  # the same where both sides have many rows at a place: the pairs of rows of two packs are held in memory
TASK_PAIRS = 2_000_000  # pairs one task should look at, as long as that makes no more than TASKS_PER_CORE tasks
TASKS_PER_CORE = 64
CELL = ["_cx", "_cy"]


def packs(df: DataFrame, place: list[str], out: str, most: int | None = None) -> DataFrame:
    """``df`` by distinct place: ``place``, the other columns as an array ``out`` of structs (of plain values if it is one column) and the
    number ``{out}p`` of the pack.

    A place with many rows makes several packs of some ``most`` rows, so no row of the result is long. Places with a null or NaN meet nothing
    and drop out.
    """
    most = min(most or PACK_ROWS, PACK_ROWS)
    d = df.dropna(subset=place)
    rest = [c for c in d.columns if c not in place]
    if not rest:
        d, rest = d.withColumn("_one", F.lit(True)), ["_one"]
    pack = F.lit(0).cast("bigint")
    if largest_group(d, place) > most:
        n = F.count(F.lit(1))
        often = d.groupBy(*place).agg(n.alias("_k")).filter(F.col("_k") > most).select(*place, F.ceil(F.col("_k") / most).alias("_k"))
        d = d.join(often, place, "left")
        pack = F.pmod(F.xxhash64(*rest), F.coalesce("_k", F.lit(1)))
    d = d.select(*place, pack.alias(f"{out}p"), F.struct(*rest).alias("_row"))
    d = d.groupBy(*place, f"{out}p").agg(F.collect_list("_row").alias(out))  # of structs, as a list of values would leave out nulls
    return cut(d if len(rest) > 1 else d.withColumn(out, F.col(out)[rest[0]]))


def meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join packs ``_a`` and ``_b`` that share a cell ``_cx, _cy``.

    Cells are dealt in parts by the number of row pairs they hold: the packs of either side go to one of several parts each, and are
    copied to the parts of the other side. Parts of about equal work are spread over the tasks, whatever the bytes of the input.
    """
    size = lambda d, o: d.groupBy(*CELL).agg(F.sum(F.size(o)).alias(f"_n{o}"), F.count(F.lit(1)).alias(f"_k{o}"))
    work = F.col("_n_a").cast("double") * F.col("_n_b")
    cells = cut(size(left, "_a").join(size(right, "_b"), CELL).withColumn("_work", work))
    total = cells.agg(F.sum("_work")).first()[0] or 0.0
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks = int(min(max(total / TASK_PAIRS, cores), TASKS_PER_CORE * cores))
    parts = F.ceil(F.col("_work") / max(total / (8 * tasks), 1.0))
    cells = cells.withColumn("_jb", F.least(parts, "_k_b")).withColumn("_ja", F.least(F.ceil(parts / F.col("_jb")), "_k_a")).select(*CELL, "_ja", "_jb")

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        place = F.xxhash64(*[c for c in d.columns if c not in (*CELL, f"_{own}")])
        d = d.join(cells, CELL).withColumn(f"_i{own}", F.pmod(place, F.col(f"_j{own}")))
        d = d.withColumn(f"_i{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_j{other}") - 1)))
        return d.drop("_ja", "_jb").repartition(tasks, *CELL, "_ia", "_ib")

    return dealt(left, "a", "b").join(dealt(right, "b", "a"), [*CELL, "_ia", "_ib"]).drop(*CELL, "_ia", "_ib", "_ap", "_bp")


def apart(found: DataFrame) -> DataFrame:
    """``found`` for a step of its own, by ``coalesce`` to no fewer partitions than there are.

    Spark holds all that a row becomes in joins and explodes that follow each other until the last of it is there: for a pack, all rows of all
    packs it meets, times its own. Apart, no more than the packs that one pack meets, or the pairs of rows of two packs, are held at a time.
    """
    return found.coalesce(TASKS_PER_CORE * found.sparkSession.sparkContext.defaultParallelism)


def unpacked(found: DataFrame, left: list[str], right: list[str], *more: str) -> DataFrame:
    """Every row of ``_a`` with every row of ``_b``: the columns ``left``, ``right`` and ``more``."""
    at = {c: F.col(c) for c in found.columns}

    def pick(names: list[str], o: str) -> list[Column]:
        one = sum(c not in at for c in names) == 1  # packs keep it as it is
        return [at.get(c, F.col(o) if one else F.col(o)[c]).alias(c) for c in names]

    d = found.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    return d.select(*pick(left, "_a"), *pick(right, "_b"), *more)


def geo_cells(left: DataFrame, right: DataFrame, km: float, l_lon: str, l_lat: str, r_lon: str, r_lat: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with degree cells ``_cx, _cy``: rows within ``km`` share exactly one cell, others one or none.

    The number of longitude cells a circle touches grows with latitude. Cells wrap at the date line: longitude cells
    divide the full turn evenly and are counted modulo their number.
    """
    s = km / 110.0
    turn = max(1, int(360.0 // s))
    sx = 360.0 / turn
    lat, lon = F.col(l_lat), F.col(l_lon)
    wide = F.least(s / F.cos(F.radians(F.least(F.abs(lat) + s, F.lit(89.0)))), F.lit(180.0))
    span = F.sequence(F.floor((lon + 180.0 - wide) / sx), F.floor((lon + 180.0 + wide) / sx))
    around = F.array_distinct(F.transform(span, lambda i: F.pmod(i, F.lit(turn).cast("bigint"))))
    a = left.withColumn("_cx", F.explode(around)).withColumn("_cy", F.explode(F.sequence(F.floor((lat - s) / s), F.floor((lat + s) / s))))
    b = right.withColumns({"_cx": F.pmod(F.floor((F.col(r_lon) + 180.0) / sx), F.lit(turn).cast("bigint")), "_cy": F.floor(F.col(r_lat) / s)})
    return a, b


def toponyms_around(sites: DataFrame, toponyms: DataFrame, radius_km: float, places: int | None = None) -> DataFrame:
    """Toponyms within ``radius_km`` of each site, measured in the site's UTM zone (``distance_km``, rounded if ``places`` is given).

    Distances are measured between distinct places; their rows are paired afterwards.
    """
    t = toponyms.withColumnsRenamed({"lon": "toponym_lon", "lat": "toponym_lat"})
    s = sites.withColumnsRenamed({"lon": "site_lon", "lat": "site_lat"})
    a = packs(s, ["site_lon", "site_lat"], "_a", PAIR_ROWS).withColumns({"_zone": geo.utm_zone(F.col("site_lon")), "_south": F.col("site_lat") < 0})
    a = geo.with_utm(a, "site_lon", "site_lat", F.col("_zone"), F.col("_south"), "_e", "_n")
    b = packs(t, ["toponym_lon", "toponym_lat"], "_b", PAIR_ROWS).withColumn("_tt", geo.conformal_t(F.col("toponym_lat")))
    # the UTM scale is at most 0.04 % short, so the search circle is a little wider than the answer
    found = meet(*geo_cells(a, b, radius_km * 1.01, "site_lon", "site_lat", "toponym_lon", "toponym_lat"))
    xi, eta = geo.gauss(F.col("toponym_lon"), F.col("_tt"), F.col("_zone"))
    e, n = geo.utm_metres(xi, eta, F.col("_south"))
    found = found.withColumn("distance_km", F.hypot(e - F.col("_e"), n - F.col("_n")) / 1000.0).filter(F.col("distance_km") <= radius_km)
    if places is not None:
        found = found.withColumn("distance_km", F.round("distance_km", places))
    return unpacked(apart(found), s.columns, t.columns, "distance_km")


def nearest_toponym(sites: DataFrame, toponyms: DataFrame, radius_km: float, tie: str) -> DataFrame:
    """The nearest row of :func:`toponyms_around` per row of ``sites``; of equally near ones that with the smallest ``tie``.

    Of the toponyms at one place only the one with the smallest ``tie`` can win, and sites at one place have the same winner.
    """
    at = ["lon", "lat"]
    rest = [c for c in toponyms.columns if c not in at]
    first = toponyms.groupBy(*at).agg(F.min_by(F.struct(*rest), tie).alias("_t")).select(*at, "_t.*")
    near = toponyms_around(sites.select(*at).distinct(), first, radius_km)
    found = [c for c in near.columns if c not in ("site_lon", "site_lat")]
    best = near.groupBy("site_lon", "site_lat").agg(F.min_by(F.struct(*found), F.struct("distance_km", tie)).alias("_n"))
    s = sites.withColumnsRenamed({"lon": "site_lon", "lat": "site_lat"})
    return s.join(best, ["site_lon", "site_lat"]).select(*s.columns, "_n.*")


def match_known(known: DataFrame, cands: DataFrame, max_m: float = 500.0) -> DataFrame:
    """Known sites joined to the nearest candidate within ``max_m`` (EPSG:32721); ties multiply rows."""
    k = with_planar(known, "utm21s")
    c = with_planar(cands, "utm21s", x="cx", y="cy")
    near = nearest(k, as_segments(c.select(F.col("cx").alias("x"), F.col("cy").alias("y"))), max_dist=max_m)
    c = c.drop("lon", "lat")
    hits = near.join(c, (F.col("x1") == F.col("cx")) & (F.col("y1") == F.col("cy"))).drop("cx", "cy", *SEG)
    return k.join(hits, ["x", "y"]).withColumnRenamed("dist", "dist_m").drop("x", "y")


def within_reach(df: DataFrame, others: DataFrame, max_m: float, project: str = "utm21s") -> DataFrame:
    """Add ``is_hit``: some row of ``others`` lies within ``max_m``. No pairs are formed."""
    d = with_planar(df, project)
    o = with_planar(others, project)
    near = nearest_distance(d, as_segments(o), max_dist=max_m).select("x", "y", F.lit(True).alias("_hit"))
    out = d.join(near, ["x", "y"], "left").withColumn("is_hit", F.coalesce("_hit", F.lit(False)))
    return out.select(*df.columns, "is_hit")


def is_hit(cands: DataFrame, known: DataFrame, max_m: float = 500.0) -> DataFrame:
    return within_reach(cands, known, max_m)


def false_positives(cands: DataFrame, known: DataFrame, max_m: float = 500.0) -> DataFrame:
    """Candidates with no known site within ``max_m``."""
    return within_reach(cands, known, max_m).filter(~F.col("is_hit")).drop("is_hit")


def far_from(df: DataFrame, positives: DataFrame, min_km: float = 1.0, project: str = "mercator") -> DataFrame:
    """Rows at least ``min_km`` (planar) from every positive."""
    d = with_planar(df, project)
    p = with_planar(positives, project)
    near = nearest_distance(d, as_segments(p), max_dist=min_km * 1000.0).filter(F.col("dist") < min_km * 1000.0)
    return d.join(near.select("x", "y"), ["x", "y"], "left_anti").select(*df.columns)


def close_pairs(sites: DataFrame, max_m: float = 200.0, key: str = "site_id", places: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of sites within ``max_m`` by haversine, with ``dist_m`` (rounded if ``places`` is given), by their distinct places."""
    p = packs(sites.select(F.col(key).alias("id"), "lon", "lat"), ["lon", "lat"], "_a", PAIR_ROWS)
    a = p.select(F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), "_ap", "_a")
    b = p.select(F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"), F.col("_ap").alias("_bp"), F.col("_a").alias("_b"))
    d = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) * 1000.0
    found = meet(*geo_cells(a, b, max_m / 1000.0, "a_lon", "a_lat", "b_lon", "b_lat")).withColumn("dist_m", d).filter(F.col("dist_m") <= max_m)
    if places is not None:
        found = found.withColumn("dist_m", F.round("dist_m", places))
    pairs = apart(found).withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    return pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "dist_m").filter(F.col("a") < F.col("b"))


def box_cells(df: DataFrame, x_min: str, y_min: str, x_max: str, y_max: str, size: float) -> DataFrame:
    """One row per grid cell a box touches (``_cx``, ``_cy``)."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return df.withColumn("_cx", span(x_min, x_max)).withColumn("_cy", span(y_min, y_max))


def points_within_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points inside boxes ``minx, miny, maxx, maxy`` (interior only, like a within test)."""
    b = box_cells(packs(boxes, ["minx", "miny", "maxx", "maxy"], "_b"), "minx", "miny", "maxx", "maxy", size)
    p = packs(points, ["lon", "lat"], "_a").withColumns({"_cx": F.floor(F.col("lon") / size), "_cy": F.floor(F.col("lat") / size)})
    inside = (
        (F.col("lon") > F.col("minx")) & (F.col("lon") < F.col("maxx"))
        & (F.col("lat") > F.col("miny")) & (F.col("lat") < F.col("maxy"))
    )
    return unpacked(meet(p, b).filter(inside), points.columns, boxes.columns)


def points_within(points: DataFrame, polys: DataFrame, size: float, x: str = "lon", y: str = "lat",
                  ring: str = "ring") -> DataFrame:
    """Points inside polygons given as ``array<struct<x,y>>``."""
    boxed = packs(polys, [ring], "_b").withColumns({
        "_x0": F.array_min(F.transform(ring, lambda v: v["x"])), "_x1": F.array_max(F.transform(ring, lambda v: v["x"])),
        "_y0": F.array_min(F.transform(ring, lambda v: v["y"])), "_y1": F.array_max(F.transform(ring, lambda v: v["y"])),
    })
    b = box_cells(boxed, "_x0", "_y0", "_x1", "_y1", size)
    p = packs(points, [x, y], "_a").withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
    in_box = F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1"))
    found = meet(p, b).filter(in_box & geo.point_in_ring(F.col(x), F.col(y), F.col(ring)))
    return unpacked(found, points.columns, polys.columns)


def spatial_confusion(true_pts: DataFrame, pred_pts: DataFrame, radius: float) -> DataFrame:
    """TP counts *pairs* within ``radius``; FP is predictions minus TP and FN the pairs that do not meet.

    Locations are counted first, so copies of a point multiply counts and not rows.
    """
    t = true_pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_true"))
    p = pred_pts.groupBy(F.col("x").alias("x2"), F.col("y").alias("y2")).agg(F.count(F.lit(1)).alias("n_pred"))
    hits = near_pairs(t, p, radius).agg(F.coalesce(F.sum(F.col("n_true") * F.col("n_pred")), F.lit(0)).alias("tp"))
    n_true, n_pred = [d.agg(F.count(F.lit(1)).alias("n")).scalar() for d in (true_pts, pred_pts)]
    out = hits.withColumns({"n_true": n_true, "n_pred": n_pred}).select(
        "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") * F.col("n_pred") - F.col("tp")).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    out = out.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))
