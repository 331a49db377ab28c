"""Seeded splits and samples. The random order is a hash of seed and key: the same on any cluster, after any retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.operators import spatial
from toposcan.operators.candidates import year_window
from toposcan.operators.ordered import ordered
from toposcan.session import cut


def hash_unit(seed: int | str, key: Column) -> Column:
    """Number in [0, 1) from the first 13 hex digits of md5('seed:key')."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**13))


def _n() -> Column:
    return F.count(F.lit(1))


def ratio_split(df: DataFrame, ratios: dict[str, float], seed: int = 42, key: str = "site_id",
                years: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
    """Add ``split`` (train, val, test): shuffled, sizes rounded down, the rest is test; optional year window per split."""
    total = sum(ratios.values())
    train, val = (ratios.get(s, 0.0) / (total if abs(total - 1.0) > 0.001 else 1.0) for s in ("train", "val"))
    d = ordered(df.withColumn("_h", hash_unit(seed, F.col(key))), "_h", key, rank="_r").withColumn("_n", df.agg(_n()).scalar())
    n_train, n_val = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    split = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    d = d.withColumn("split", split).drop("_h", "_r", "_n")
    for name, (lo, hi) in (years or {}).items():
        keep = F.col("split") != name
        if lo is not None or hi is not None:
            keep = keep | F.col("discovery_year").between(lo if lo is not None else -10**6, hi if hi is not None else 10**6)
            d = d.filter(keep)
    return d


def stratified_split(df: DataFrame, val_ratio: float = 0.3, seed: int = 42, key: str = "site_id", by: str = "culture_tag") -> DataFrame:
    """Add ``split`` (train, val) with the same share in every stratum.

    The validation part is ``val_ratio`` of all usable rows, rounded up. The train part is shared over the strata in proportion,
    rounded down, and what is missing goes to the strata with the largest remainders (ties by their name).
    Strata with one row are left out; with fewer than four rows in the others the split is plain.
    """
    sizes = df.groupBy(by).agg(_n().alias("_nc")).filter(F.col(by).isNotNull())
    usable = sizes.filter(F.col("_nc") >= 2)
    rows = usable.agg(F.coalesce(F.sum("_nc"), F.lit(0))).first()[0]
    d = df.withColumn("_h", hash_unit(seed, F.col(key)))
    if rows >= 4:
        train = rows - math.ceil(rows * val_ratio)
        shares = usable.withColumn("_share", F.col("_nc") * (train / rows)).withColumn("_t", F.floor("_share"))
        missing = train - shares.agg(F.sum("_t")).first()[0]
        named = shares.withColumns({"_rest": F.col("_share") - F.col("_t"), "_name": F.dense_rank().over(Window.orderBy(by))})  # a row per stratum
        shares = ordered(named, "_rest", "_name", desc=True, rank="_place")
        n_val = F.col("_nc") - F.col("_t") - F.when(F.col("_place") <= missing, 1).otherwise(0)
        d = ordered(d.join(shares.select(by, n_val.alias("_n_val")), by), "_h", key, rank="_r", by=[by])
    else:
        n = df.agg(F.ceil(_n() * val_ratio))
        d = ordered(d, "_h", key, rank="_r").withColumn("_n_val", n.scalar())
    return d.withColumn("split", F.when(F.col("_r") <= F.col("_n_val"), "val").otherwise("train")).select(*df.columns, "split")


def time_split(df: DataFrame, year: int, val_ratio: float | None = None, seed: int = 42, key: str = "site_id") -> DataFrame:
    """Sites found before ``year`` become train and val (or val only without a ratio), later ones ``test_time``."""
    early, late = df.filter(F.col("discovery_year") < year), df.filter(F.col("discovery_year") >= year)
    early = early.withColumn("split", F.lit("val")) if val_ratio is None else stratified_split(early, val_ratio, seed, key)
    return early.unionByName(late.withColumn("split", F.lit("test_time")))


def region_split(df: DataFrame, blocks: dict[str, list[str] | None]) -> DataFrame:
    """Rows of the configured cultures with ``region``; a list restricts a culture to those sites."""
    keep, region = F.lit(False), F.col("culture_tag")
    for tag, sites in blocks.items():
        cond = region == tag
        keep = keep | (cond & F.col("site_name").isin(sites) if sites else cond)
    return df.filter(keep).withColumn("region", region)


def negative_samples(positives: DataFrame, bbox: tuple[float, float, float, float], ratio: float = 4.0, min_km: float = 1.0,
                     seed: int = 42, max_attempts: int | None = None) -> DataFrame:
    """Uniform points in a box at least ``min_km`` (planar EPSG:3857) from every positive, ``ratio`` times as many.

    Attempts are numbered, and the first that are far enough count. They begin with ``max_attempts``, by default 10000 or three times
    the wanted number when that is more; each further round goes on where the last one ended, to four times as many, until enough are found. A box
    in which a round of more than a million attempts finds nothing has no room for more: the points found so far are the result.
    """
    want = int(positives.count() * ratio)
    attempts = max_attempts or max(10_000, 3 * want)
    w, s, e, n = bbox
    segments = spatial.as_segments(spatial.with_planar(positives))

    def tried(first: int, past: int) -> DataFrame:
        pts = positives.sparkSession.range(first, past).withColumnsRenamed({"id": "attempt"}).withColumns({
            "lon": w + (e - w) * hash_unit(f"{seed}x", F.col("attempt")), "lat": s + (n - s) * hash_unit(f"{seed}y", F.col("attempt"))})
        p = spatial.with_planar(pts)
        return cut(p.join(spatial.nearest_distance(p, segments), ["x", "y"]).filter(F.col("dist") >= min_km * 1000.0))

    far = tried(0, attempts)
    found = far.count()
    while found < want:
        more = tried(attempts, 4 * attempts)
        far, new, attempts = far.unionByName(more), more.count(), 4 * attempts
        if not new and attempts > 1_000_000:
            break
        found += new
    far = ordered(far.select("attempt", "lon", "lat", "dist"), "attempt", "attempt").filter(F.col("rank") <= want)
    return far.select(
        F.format_string("negative_%04d", F.col("rank") - 1).alias("site_name"), "lon", "lat", F.lit("negative").alias("culture_tag"),
        F.lit(-1).alias("discovery_year"), (F.col("dist") / 1000.0).alias("min_distance_to_positive_km"))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "cand_id") -> DataFrame:
    """A seeded sample of n rows; ranked in parts, so a large n does not pass through one task."""
    d = ordered(df.withColumn("_h", hash_unit(seed, F.col(key))), "_h", key, rank="_r")
    return d.filter(F.col("_r") <= n).select(*df.columns)


LABELED = ["site_name", "lat", "lon", "culture_tag", "discovery_year", "is_positive"]


def merge_labeled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives and negatives with ``is_positive``, common columns only."""
    both = positives.withColumn("is_positive", F.lit(True)).unionByName(
        negatives.withColumn("is_positive", F.lit(False)), allowMissingColumns=True)
    return both.select(*[c for c in LABELED if c in both.columns])


def split_window(df: DataFrame, split: str, min_year: int | None, max_year: int | None) -> DataFrame:
    """Rows of a split inside its year window; other splits are untouched."""
    return year_window(df.filter(F.col("split") == split), min_year, max_year).unionByName(df.filter(F.col("split") != split))
