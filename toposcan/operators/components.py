"""Connected components, merging of nearby sites, regions of equal cells, overlapping buffers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.functions import geo
from toposcan.functions.geodesic import geodesic_m
from toposcan.operators.ordered import ordered
from toposcan.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` edges; the label is the smallest node of the component.

    Alternating large-star and small-star steps: a logarithmic number of rounds even for long chains, until a round
    changes nothing. Each round is checkpointed; only a count and a checksum come to the driver.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b"), F.col("m").alias("a")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
        e = cut(small.select("e.*").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            roots = e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
            return e.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
        mark = now


def _gap(kind: str, sphere: bool) -> Column:
    """Smallest (``near``) or largest (``far``) distance between two boxes; metres on a sphere for degrees."""
    def span(axis: str) -> Column:
        a0, a1, b0, b1 = (F.col(f"{side}.{axis}{end}") for side in "pq" for end in "01")
        if kind == "far":
            return F.greatest(b1 - a0, a1 - b0)
        return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)

    if not sphere:
        return F.hypot(span("x"), span("y"))
    lats = [F.abs(F.col(f"{s}.y{e}")) for s in "pq" for e in "01"]
    m = math.radians(1) * geo.EARTH_KM * 1000
    return F.hypot(span("y") * m, span("x") * m * F.cos(F.radians(F.least(*lats) if kind == "far" else F.greatest(*lats))))


def _box() -> Column:
    return F.struct("cell", "_fx", "_fy", "x0", "x1", "y0", "y1")


FINE = 8  # finer parts per side of a cell


def _within(pairs: DataFrame, reach: float, slack: float, sphere: bool) -> DataFrame:
    """Pairs of boxes that may lie within reach: cells ``a, b``, the boxes and their largest distance."""
    d = pairs.select("p", "q", _gap("near", sphere).alias("near"), _gap("far", sphere).alias("far")).filter(F.col("near") <= reach * (1 + slack))
    return d.select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), "p", "q", "far")


def _sure(pairs: DataFrame, reach: float, slack: float) -> DataFrame:
    return pairs.filter(F.col("far") <= reach * (1 - slack)).select("a", "b").distinct()


def link_labels(points: DataFrame, reach: float, sphere: bool) -> DataFrame:
    """``x, y, label`` of every distinct location; equal labels for locations linked by steps of at most ``reach``.

    ``sphere``: x, y are degrees and steps are geodesic metres; else plane coordinates. Cells are small
    enough that all locations in one are linked, so a crowded cell is a single node. Two cells are linked when
    a part of one surely lies within reach of a part of the other (by the boxes of the parts). That is tried
    with a few coarse parts; cells not connected by then are tried with finer parts, and only parts that may or may not
    reach, of cells still apart, compare locations.
    """
    side, slack = reach / math.sqrt(2) / (111700.0 if sphere else 1.0), 0.01 if sphere else 1e-9
    pts = points.select("x", "y").dropna().distinct()
    pts = pts.withColumns({f"_f{a}": F.floor(F.col(a) / (side / FINE)).cast("bigint") for a in "xy"})
    pts = pts.withColumns({f"_c{a}": F.floor(F.col(f"_f{a}") / FINE) for a in "xy"})
    pts = cut(pts.withColumn("cell", (F.col("_cx") * F.lit(1 << 31) + F.col("_cy") + F.lit(1 << 30)).cast("bigint")))
    parts = pts.groupBy("cell", "_cx", "_cy", "_fx", "_fy").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    parts = cut(parts)
    half = lambda c: F.floor(F.col(c) / (FINE // 2)).alias(c)
    coarse = parts.groupBy("cell", "_cx", "_cy", half("_fx"), half("_fy")).agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    top = F.least(F.greatest(F.abs("y0"), F.abs("y1")) + 0.01, F.lit(89.0))
    wide = F.ceil(F.lit(math.sqrt(2) * 1.01) / F.cos(F.radians(top))) if sphere else F.lit(2)
    near = lambda c, r: F.explode(F.sequence(F.col(c) - r, F.col(c) + r))
    left = coarse.select(_box().alias("p"), near("_cx", wide).alias("_cx"), "_cy").select("p", "_cx", near("_cy", 2).alias("_cy"))
    tried = left.join(coarse.select(_box().alias("q"), "_cx", "_cy"), ["_cx", "_cy"]).filter(F.col("p.cell") < F.col("q.cell"))
    tried = cut(_within(tried, reach, slack, sphere))
    sure = _sure(tried, reach, slack)
    done = cut(components(sure))
    apart = tried.select("a", "b").distinct()
    for end in "ab":
        apart = apart.join(done.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end, "left")
    apart = apart.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    fine = apart.join(parts.select(F.col("cell").alias("a"), _box().alias("p")), "a").join(parts.select(F.col("cell").alias("b"), _box().alias("q")), "b")
    fine = cut(_within(fine.select("p", "q"), reach, slack, sphere))
    sure_fine = _sure(fine, reach, slack)
    open_ = fine.join(sure_fine, ["a", "b"], "left_anti")
    open_ = open_.select("a", "b", F.col("p._fx").alias("_fx"), F.col("p._fy").alias("_fy"), F.col("q._fx").alias("_gx"), F.col("q._fy").alias("_gy"))
    other = pts.select(F.col("_fx").alias("_gx"), F.col("_fy").alias("_gy"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    tested = open_.join(pts.select("_fx", "_fy", "x", "y"), ["_fx", "_fy"]).join(other, ["_gx", "_gy"])
    dist = geodesic_m("y", "x", "y2", "x2") if sphere else F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    tested = tested.withColumn("d", dist).filter(F.col("d") <= reach).select("a", "b").distinct()
    # what is known is carried on as the edges from each node to its label
    known = done.select(F.col("label").alias("a"), F.col("node").alias("b")).filter("a <> b")
    labels = components(known.unionByName(sure_fine).unionByName(tested))
    located = pts.select("x", "y", F.col("cell").alias("node")).join(labels, "node", "left")
    return located.select("x", "y", F.coalesce("label", "node").alias("label"))


def cluster_sites(sites: DataFrame, max_m: float = 200.0, order: str = "site_id") -> DataFrame:
    """Add ``cluster_id``: 0, 1, ... by the first member in input order."""
    labels = link_labels(sites.select(F.col("lon").alias("x"), F.col("lat").alias("y")), max_m, sphere=True)
    d = sites.join(labels.withColumnsRenamed({"x": "lon", "y": "lat"}), ["lon", "lat"])
    first = d.groupBy("label").agg(F.min(order).alias("_first"))
    ids = ordered(first, "_first", "_first", rank="_id").select("label", (F.col("_id") - 1).alias("cluster_id"))
    return d.join(ids, "label").drop("label")


def merge_sites(clustered: DataFrame, order: str = "site_id") -> DataFrame:
    """One row per cluster: name, number of members, mean position, tags of the first member.

    The members themselves are rows of :func:`cluster_members`, as a cluster may hold any share of the sites.
    """
    tags = [c for c in ("region", "culture_tag") if c in clustered.columns]
    aggs = [F.count(F.lit(1)).alias("n_merged_sites"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
            F.min_by(F.struct("site_name", *tags), order).alias("_f")]
    d = clustered.groupBy("cluster_id").agg(*aggs)
    name = F.col("_f.site_name")
    merged = F.when(F.col("n_merged_sites") == 1, name).otherwise(F.concat(name, F.lit("_cluster"), F.col("cluster_id").cast("string")))
    cols = ["cluster_id", merged.alias("site_name"), "n_merged_sites", "lat", "lon", *[F.col(f"_f.{t}").alias(t) for t in tags]]
    return d.select(*cols)


def cluster_members(clustered: DataFrame, order: str = "site_id") -> DataFrame:
    """``cluster_id, ord, original_name, lat, lon``: the members of each cluster, a row each."""
    return clustered.select("cluster_id", F.col(order).alias("ord"), F.col("site_name").alias("original_name"), "lat", "lon")


def label_regions(cells: DataFrame, connectivity: int = 4, value: str = "value") -> DataFrame:
    """Regions of equal neighbouring cells: ``region_id, value, n_cells`` and bounding box; ids by first cell.

    Cells are first joined to runs along their row, so edges link runs and not single cells.
    """
    w = Window.partitionBy("row").orderBy("col")
    new = ~(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.lag("col").over(w) == F.col("col") - 1))
    d = cells.filter(F.col(value).isNotNull()).withColumn("_new", F.when(new, 1).otherwise(0))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy("row", "_run", value).agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    runs = cut(runs.withColumn("node", (F.col("row") * F.lit(1 << 32) + F.col("c0")).cast("bigint")))
    reach = 1 if connectivity == 8 else 0
    # overlapping runs of the next row: matched on blocks of columns, then tested
    size = 256
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))).alias("_blk")
    a = runs.select(F.col("node").alias("a"), (F.col("row") + 1).alias("row"), F.col(value).alias("_v"), F.col("c0").alias("a0"),
                    F.col("c1").alias("a1"), blocks(F.col("c0") - reach, F.col("c1") + reach))
    b = runs.select(F.col("node").alias("b"), "row", F.col(value).alias("_v"), "c0", "c1", blocks(F.col("c0"), F.col("c1")))
    meet = a.join(b, ["row", "_v", "_blk"]).filter((F.col("a0") - reach <= F.col("c1")) & (F.col("c0") <= F.col("a1") + reach))
    labels = components(meet.select("a", "b").distinct())
    d = runs.join(labels, "node", "left").withColumn("region_id", F.coalesce("label", "node"))
    return d.groupBy("region_id").agg(
        F.first(value).alias("value"), F.sum(F.col("c1") - F.col("c0") + 1).alias("n_cells"), F.min("row").alias("row_min"),
        F.max("row").alias("row_max"), F.min("c0").alias("col_min"), F.max("c1").alias("col_max"))


def make_buffers(df: DataFrame, radius_km: float, key: str = "site_id", dissolve: bool = False) -> DataFrame:
    """Circles around points as ``x, y`` (EPSG:3857), ``radius_m`` and ``area_km2``.

    ``dissolve`` adds ``group``: equal for circles that overlap, directly or through others.
    """
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    d = df.withColumns({"x": x, "y": y, "radius_m": F.lit(radius_km * 1000.0), "area_km2": F.lit(math.pi * radius_km * radius_km)})
    if not dissolve:
        return d
    return d.join(link_labels(d, 2000.0 * radius_km, sphere=False).withColumnRenamed("label", "group"), ["x", "y"])
