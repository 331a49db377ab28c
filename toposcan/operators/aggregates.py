"""Counts, summaries and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.functions import text
from toposcan.operators.ordered import MAX_GROUP, largest_group, quantiles

# Expected frequency of a root by category, and of any other category.
CATEGORY_FREQUENCY = {"water": 15, "terrain": 8, "flora": 6, "culture": 4, "resource": 3, "temporal": 5}
OTHER_FREQUENCY = 5
DIRECTIONS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row tables side by side, as scalar subqueries."""
    head, *rest = frames
    for f in rest:
        packed = f.select(F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias("_s")).scalar()
        head = head.withColumn("_s", packed).select(*head.columns, *[F.col("_s")[c].alias(c) for c in f.columns])
    return head


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(F.col(col).isNotNull()).orderBy(F.desc("n"), col)


def site_centers(df: DataFrame) -> DataFrame:
    return df.groupBy("site_name").agg(
        F.avg("site_lat").alias("center_lat"), F.avg("site_lon").alias("center_lon"), F.count(F.lit(1)).alias("n_toponyms"))


def dataset_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("discovery_year").alias("year_min"), F.max("discovery_year").alias("year_max"),
        F.avg("discovery_year").alias("year_mean"),
        F.max("lat").alias("north"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.min("lon").alias("west"))


def dict_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_entries"), F.countDistinct("canonical_name").alias("unique_canonical"),
        F.countDistinct("root").alias("unique_roots"), F.avg(F.col("confidence").try_cast("double")).alias("avg_confidence"))


def root_stats(df: DataFrame) -> DataFrame:
    """Roots, and roots with a token, per language."""
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("total_roots"), F.count("regex_token").alias("with_token"))


def workload(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("workload"))


def entropy(df: DataFrame, col: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy (natural logarithm) of a column; nulls count in the total, not as a value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    p = F.col("n") / total
    return counts.filter(F.col(col).isNotNull()).agg(F.coalesce(F.sum(-p * F.log(p)), F.lit(0.0)).alias(out))


def spatial_distribution(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return df.agg(
        (F.max(x) - F.min(x)).alias("bbox_width"), (F.max(y) - F.min(y)).alias("bbox_height"),
        F.stddev_pop(x).alias("coord_std_x"), F.stddev_pop(y).alias("coord_std_y"),
        F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"))


def _stats(col: str, prefix: str) -> list[Column]:
    return [F.min(col).alias(f"{prefix}_min"), F.max(col).alias(f"{prefix}_max"), F.avg(col).alias(f"{prefix}_mean"),
            F.stddev_samp(col).alias(f"{prefix}_std")]


def polar_summary(df: DataFrame) -> DataFrame:
    """Angle and radius statistics, counts in 8 directions and 5 equal radius bins."""
    top = df.agg(F.max("radius")).scalar()
    sector = F.least(F.floor(F.col("angle") / 45.0), F.lit(7))
    ring = F.least(F.floor(F.try_divide(F.col("radius") * 5.0, F.col("_top"))), F.lit(4))
    binned = df.withColumn("_top", top).withColumns({"_sector": sector, "_ring": ring})
    return binned.agg(
        F.count(F.lit(1)).alias("total_toponyms"), *_stats("angle", "angle"), *_stats("radius", "radius"),
        *[F.count_if(F.col("_sector") == i).alias(f"dir_{d}") for i, d in enumerate(DIRECTIONS)],
        *[F.count_if(F.col("_ring") == i).alias(f"ring_{i + 1}") for i in range(5)])


def river_summary(df: DataFrame, max_km: float = 50.0) -> DataFrame:
    """Coverage, statistics and distance bins of the rows that have a river within ``max_km``."""
    valid = F.col("river_radius") <= max_km
    d = df.withColumns({"_a": F.when(valid, F.col("river_angle")), "_r": F.when(valid, F.col("river_radius"))})
    edges = [0.0, 1.0, 5.0, 10.0, 20.0, max_km]
    bins = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        upper = F.col("_r") <= hi if i == len(edges) - 2 else F.col("_r") < hi
        bins.append(F.count_if((F.col("_r") >= lo) & upper).alias(f"bin_{i + 1}"))
    return d.agg(
        F.count(F.lit(1)).alias("total_toponyms"), F.count("_r").alias("valid_river_distances"),
        F.try_divide(F.count("_r"), F.count(F.lit(1))).alias("coverage_rate"),
        *_stats("_a", "river_angle"), *_stats("_r", "river_radius"), *bins)


def top_rivers(df: DataFrame, max_km: float = 50.0, k: int = 10) -> DataFrame:
    near = df.filter(F.col("river_radius") <= max_km)
    return value_counts(near, "nearest_river").limit(k)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins included."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    d = df.filter(F.col(col).isNotNull()).withColumn("_s", span)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    no = F.least(F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("_s.lo"), width), F.lit(0.0))), F.lit(bins - 1))
    counts = d.groupBy(no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_s", span)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("_s.lo") + F.col("bin") * width).alias("lower"),
        (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def summarize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, max, min and sample deviation per column, one row each."""
    long = df.unpivot([], list(cols), "column", "value") if len(cols) > 1 else df.select(
        F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("value"))
    stats = long.groupBy("column").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"),
        F.stddev_samp("value").alias("std"))
    return stats.join(quantiles(long, "value", {"median": 0.5}, ["column"]), "column", "left")


def dashboard(frames: dict[str, DataFrame]) -> DataFrame:
    """Count, mean and best score, mean distance and occurrence per dataset."""
    labelled = [f.select(F.lit(name).alias("dataset"), "total_score", "dist_km", "occ_pct") for name, f in frames.items()]
    return reduce(DataFrame.unionByName, labelled).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.avg("total_score").alias("mean_score"), F.max("total_score").alias("max_score"),
        F.avg("dist_km").alias("mean_distance"), F.avg("occ_pct").alias("mean_occurrence"))


def root_score_stats(df: DataFrame, root: str = "root") -> DataFrame:
    return df.groupBy(root).agg(
        F.count("total_score").alias("n"), F.avg("total_score").alias("mean"),
        F.coalesce(F.stddev_samp("total_score"), F.lit(0.0)).alias("std"))


def pair_corr(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])


def null_counts(df: DataFrame) -> DataFrame:
    """``column, n_null`` for every column, one scan."""
    flat = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return flat.unpivot([], df.columns, "column", "n_null")


def merge_summary(merged: DataFrame) -> DataFrame:
    """Effect of merging sites, from ``n_merged_sites``."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum("n_merged_sites"), F.lit(0))
    return merged.agg(
        n.alias("total_sites"), F.count_if(F.col("n_merged_sites") > 1).alias("merged_clusters"),
        F.count_if(F.col("n_merged_sites") == 1).alias("individual_sites"), total.alias("total_original_sites"),
        (total - n).alias("reduction_count"),
        F.coalesce(F.try_divide((total - n) * 100.0, total), F.lit(0.0)).alias("reduction_percentage"))


def baseline_estimates(cands: DataFrame, known: DataFrame) -> DataFrame:
    """Rough metrics from counts alone."""
    n_known = known.agg(F.count(F.lit(1))).scalar()
    word = text.first_word(F.col("name"))
    d = cands.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif(word, F.lit(""))).alias("words")).withColumn("k", n_known)
    n = F.col("n")
    some = (n > 0) & (F.col("k") > 0)
    return d.filter(some).select(
        n.cast("double").alias("workload"),
        F.least(F.lit(0.8), n / F.greatest(F.lit(1), F.col("k")) * 0.3).alias("recall_100"),
        F.when(n < 300, 0.4).when(n < 800, 0.3).otherwise(0.2).alias("map"),
        (F.col("words") / n * 10).alias("root_diversity"))


def default_weights(counts: DataFrame, n: str = "n") -> DataFrame:
    """Weight per root from its frequency, on a log scale, two decimals."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.log10(F.col(n) + 1.0) / 3.0))
    return counts.withColumn("weight", F.bround(F.when(F.col(n) > 0, w).otherwise(0.1), 2))


def estimated_root_counts(roots: DataFrame, jitter: float | None = None) -> DataFrame:
    """Expected count per root: category frequency times weight times a factor in [0.8, 1.2) fixed by the root."""
    base = F.lit(OTHER_FREQUENCY)
    for category, freq in CATEGORY_FREQUENCY.items():
        base = F.when(F.col("category") == category, freq).otherwise(base)
    factor = F.lit(jitter) if jitter is not None else 0.8 + 0.4 * F.pmod(F.xxhash64("root"), F.lit(1000)) / 1000.0
    count = F.greatest(F.lit(1), F.floor(base * F.coalesce(F.col("weight").cast("double"), F.lit(0.5)) * factor))
    return roots.filter(F.col("root").isNotNull() & (F.col("root") != "")).withColumn("estimated", count.cast("bigint"))


CATEGORIES = ["waterway", "natural", "place", "highway", "landuse", "man_made"]


def distance_aggs() -> list[Column]:
    return [F.min("radius").alias("min_distance"), F.max("radius").alias("max_distance"),
            F.avg("radius").alias("mean_distance"), F.stddev_samp("radius").alias("std_distance")]


def river_aggs() -> list[Column]:
    return [F.min("river_radius").alias("min_river_distance"), F.avg("river_radius").alias("mean_river_distance"),
            F.stddev_samp("river_radius").alias("std_river_distance"),
            F.avg("river_angle").alias("river_angle_mean"), F.stddev_pop("river_angle").alias("river_angle_std")]


def ring_aggs() -> list[Column]:
    out = []
    for km in (1.0, 2.0, 3.0):
        near = F.col("radius") <= km
        out.append(F.count_if(near).alias(f"count_within_{km:.0f}km"))
        out += [F.count_if(near & (F.col("toponym_category") == c)).alias(f"{c}_count_{km:.0f}km") for c in CATEGORIES]
        out.append((F.count_if(near) / (math.pi * km * km)).alias(f"density_{km:.0f}km"))
    return out


def angle_aggs() -> list[Column]:
    quads = [F.count_if((F.col("angle") >= 90.0 * i) & (F.col("angle") < 90.0 * (i + 1))) for i in range(4)]
    total = reduce(lambda a, b: a + b, quads)
    terms = [F.when(q > 0, -(q / total) * F.log2(q / total)).otherwise(0.0) for q in quads]
    return [F.avg("angle").alias("angle_mean"), F.stddev_pop("angle").alias("angle_std"),
            (F.max("angle") - F.min("angle")).alias("angle_range"),
            *[q.alias(f"quadrant_{i + 1}_count") for i, q in enumerate(quads)],
            reduce(lambda a, b: a + b, terms).alias("angle_entropy")]


def ratio_aggs() -> list[Column]:
    return [(F.count_if(F.col("toponym_category") == c) / F.count(F.lit(1))).alias(f"{c}_ratio") for c in [*CATEGORIES, "other"]]


def shape_aggs() -> list[Column]:
    return [F.skewness("radius").alias("distance_skewness"), F.kurtosis("radius").alias("distance_kurtosis")]


def _with_category(df: DataFrame) -> DataFrame:
    return df.withColumn("toponym_category", text.toponym_category(F.col("toponym_name")))


def _by_site(df: DataFrame, aggs: list[Column]) -> DataFrame:
    return df.groupBy("site_name").agg(*aggs)


def distance_features(df: DataFrame) -> DataFrame:
    q = quantiles(df, "radius", {"q25_distance": 0.25, "median_distance": 0.5, "q75_distance": 0.75}, ["site_name"])
    out = _by_site(df, distance_aggs()).join(q, "site_name", "left")
    return out.withColumn("iqr_distance", F.col("q75_distance") - F.col("q25_distance"))


def river_features(df: DataFrame) -> DataFrame:
    q = quantiles(df, "river_radius", {"median_river_distance": 0.5}, ["site_name"])
    return _by_site(df, river_aggs()).join(q, "site_name", "left")


def ring_features(df: DataFrame) -> DataFrame:
    return _by_site(_with_category(df), ring_aggs())


def angle_features(df: DataFrame) -> DataFrame:
    return _by_site(df, angle_aggs())


def ratio_features(df: DataFrame) -> DataFrame:
    return _by_site(_with_category(df), ratio_aggs())


def shape_features(df: DataFrame) -> DataFrame:
    return _by_site(df, shape_aggs())


def engineer_features(df: DataFrame) -> DataFrame:
    """All features per site: one aggregation; the exact quantiles apart where a site is too large for a buffer."""
    aggs = [F.count(F.lit(1)).alias("total_toponyms"), *distance_aggs(), *river_aggs(), *ring_aggs(), *angle_aggs(),
            *ratio_aggs(), *shape_aggs()]
    qs = [("radius", {"q25_distance": 0.25, "median_distance": 0.5, "q75_distance": 0.75}), ("river_radius", {"median_river_distance": 0.5})]
    out = _by_site(_with_category(df), aggs)
    if largest_group(df, ["site_name"]) <= MAX_GROUP:
        # apart from the counts, which would otherwise leave generated code
        q = _by_site(df, [F.percentile(c, p).alias(o) for c, probs in qs for o, p in probs.items()])
        out = out.join(q, "site_name", "left")
    else:
        for c, probs in qs:
            out = out.join(quantiles(df, c, probs, ["site_name"]), "site_name", "left")
    return out.withColumn("iqr_distance", F.col("q75_distance") - F.col("q25_distance"))
