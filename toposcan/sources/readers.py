"""Tables from files: sites, features, rivers, raster cells, trials, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from toposcan.operators.candidates import in_bbox
from toposcan.operators.ordered import ordered

# Accepted names of coordinate columns.
LAT_NAMES = ("lat", "latitude", "y")
LON_NAMES = ("lon", "longitude", "lng", "x")
# Culture patterns in file names, tried in this order.
CULTURE_PATTERNS = [
    ("acre", ["acre"]),
    ("santarem", ["santarem", "santarém"]),
    ("marajo", ["marajo", "marajó"]),
    ("casarabe", ["casarabe"]),
    ("kuhikugu", ["kuhikugu", "xingu"]),
    ("upano", ["upano"]),
]
DEFAULT_YEAR = 2015
FEATURE_KEYS = ("place", "landuse", "man_made", "highway")
NODATA = 255.0
TRIAL_SCHEMA = ("id BIGINT, D DOUBLE, O DOUBLE, score DOUBLE, weights MAP<STRING,DOUBLE>, "
                "fp_roots MAP<STRING,BIGINT>")


def normalize_sites(df: DataFrame, order: str | None = None) -> DataFrame:
    """Rename coordinate columns to ``lat, lon``, drop rows without them, make sure ``site_name`` exists.

    Without a name column the sites are numbered by ``order`` (default: latitude), distinct positions
    being decided by longitude.
    """
    pick = lambda names: [c for c in df.columns if c.lower() in names]
    lats, lons = pick(LAT_NAMES), pick(LON_NAMES)
    if not lats or not lons:
        raise ValueError(f"no coordinate columns in {df.columns}")
    out = df.withColumnsRenamed({lats[-1]: "lat", lons[-1]: "lon"})
    out = out.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")}).dropna(subset=["lat", "lon"])
    if "site_name" not in out.columns:
        if "name" in out.columns:
            out = out.withColumn("site_name", F.col("name"))
        else:
            out = ordered(out, order or "lat", "lon", rank="_i")
            out = out.withColumn("site_name", F.concat(F.lit("Site_"), (F.col("_i") - 1).cast("string"))).drop("_i")
    return out


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return normalize_sites(spark.read.csv(path, header=True))


def culture_of(path: Column, configured: Sequence[str] = ()) -> Column:
    """Culture tag from a file path: configured tags first, then the known patterns."""
    name = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    tests = [(tag, [tag]) for tag in configured] + CULTURE_PATTERNS
    out = None
    for tag, pats in tests:
        hit = F.coalesce(*[F.when(name.contains(p), True) for p in pats], F.lit(False))
        out = F.when(hit, tag) if out is None else out.when(hit, tag)
    return out.otherwise("unknown")


def with_culture_from_path(df: DataFrame, path: Column | None = None, configured: Sequence[str] = ()) -> DataFrame:
    """Fill ``culture_tag`` from the file name and ``discovery_year`` with the default, where missing."""
    path = F.col("_metadata.file_path") if path is None else path
    tag = culture_of(path, configured)
    year = F.lit(DEFAULT_YEAR)
    return df.withColumns({
        "culture_tag": F.coalesce(F.col("culture_tag"), tag) if "culture_tag" in df.columns else tag,
        "discovery_year": F.coalesce(F.col("discovery_year"), year) if "discovery_year" in df.columns else year,
    })


def select_features(df: DataFrame, bbox: tuple[float, float, float, float] | None = None,
                    keys: Sequence[str] = FEATURE_KEYS, tags: str = "tags") -> DataFrame:
    """Features with one of the key classes inside the box; one row per key a feature has."""
    if bbox:
        df = in_bbox(df, bbox)
    wanted = F.array(*[F.lit(k) for k in keys])
    return df.withColumn("key_class", F.explode(F.array_intersect(F.map_keys(tags), wanted)))


def read_features(spark: SparkSession, path: str, bbox=None, keys: Sequence[str] = FEATURE_KEYS) -> DataFrame:
    return select_features(spark.read.parquet(path), bbox, keys)


def select_rivers(df: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """River segments, the needed columns only; with a box those whose own box meets it."""
    if bbox:
        w, s, e, n = bbox
        df = df.filter((F.least("x1", "x2") <= e) & (F.greatest("x1", "x2") >= w)
                       & (F.least("y1", "y2") <= n) & (F.greatest("y1", "y2") >= s))
    return df.select("river_id", "ord_stra", "main_riv", "x1", "y1", "x2", "y2")


def read_rivers(spark: SparkSession, path: str, bbox=None) -> DataFrame:
    return select_rivers(spark.read.parquet(path), bbox)


def mask_nodata(df: DataFrame, nodata: float = NODATA, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit(nodata)))


def read_cells(spark: SparkSession, paths: Sequence[str], nodata: float = NODATA) -> DataFrame:
    """Raster cells of one or many tiles."""
    return mask_nodata(spark.read.parquet(*paths), nodata)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial log, one JSON object per line; broken lines are dropped."""
    return spark.read.schema(TRIAL_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def parse_trial_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Classify log lines (trial, error, warning, params) and take number and score from trial lines."""
    c = F.trim(F.col(line))
    is_trial = c.contains("Trial") & c.contains("finished with value")
    number = F.regexp_extract(c, r"Trial (\d+) finished with value: (\S+)", 1).try_cast("bigint")
    score = F.rtrim(F.regexp_extract(c, r"Trial (\d+) finished with value: (\S+)", 2), F.lit(".")).try_cast("double")
    kind = (
        F.when(is_trial, "trial").when(c.contains("ERROR"), "error")
        .when(c.contains("WARNING") | c.contains("Warning"), "warning")
        .when(c.contains("distance_km") | c.contains("occ_pct"), "params")
    )
    out = lines.withColumns({"kind": kind, "trial_number": F.when(is_trial, number), "score": F.when(is_trial, score)})
    return out.filter((F.col("kind") != "trial") | (F.col("trial_number").isNotNull() & F.col("score").isNotNull()))


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_trial_log(spark.read.text(path).withColumnRenamed("value", "line"))


def region_box(df: DataFrame, regions: DataFrame, name: str = "region") -> DataFrame:
    """Add ``bbox`` of the region that each row names; null where the catalogue does not have it."""
    one = regions.groupBy(F.col("region").alias(name)).agg(F.first("bbox").alias("bbox"))
    return df.join(one, name, "left")


def validate_regions(df: DataFrame) -> DataFrame:
    """Add ``bbox_valid``: four numbers in range, west < east and south < north. ``bbox`` is an array."""
    b = [F.get(F.col("bbox"), F.lit(i)) for i in range(4)]
    ok = (
        (F.size("bbox") == 4) & b[0].between(-180, 180) & b[2].between(-180, 180)
        & b[1].between(-90, 90) & b[3].between(-90, 90) & (b[0] < b[2]) & (b[1] < b[3])
    )
    return df.withColumn("bbox_valid", F.coalesce(ok, F.lit(False)))
