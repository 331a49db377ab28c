"""Outputs: export columns, candidate files, placemark rows, trial log, splits, feature cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from toposcan.functions.geo import to_wkt

# Columns that lead an export, in this order.
EXPORT_FIRST = ["site_name", "toponym_name", "angle", "radius", "river_angle", "river_radius", "region", "culture_tag",
                "toponym_lat", "toponym_lon", "site_lat", "site_lon"]
EXPORT_DECIMALS = {"angle": 2, "radius": 3, "river_angle": 2, "river_radius": 3}


def prepare_export(df: DataFrame, columns: Sequence[str] = (), decimals: dict[str, int] | None = None) -> DataFrame:
    """Chosen columns, rounded half to even, priority columns first, null strings as ''."""
    decimals = EXPORT_DECIMALS if decimals is None else decimals
    names = [c for c in columns if c in df.columns] or df.columns
    names = names + [c for c in ("toponym_lat", "toponym_lon") if c in df.columns and c not in names]
    names = [c for c in EXPORT_FIRST if c in names] + [c for c in names if c not in EXPORT_FIRST]
    out = []
    for c in names:
        kind = df.schema[c].dataType
        col = F.col(c)
        if c in decimals and isinstance(kind, T.NumericType):
            col = F.bround(col, decimals[c])
        elif isinstance(kind, T.StringType):
            col = F.coalesce(col, F.lit(""))
        out.append(col.alias(c))
    return df.select(*out)


def write_export(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    prepare_export(df, columns).write.mode("overwrite").csv(path, header=True)


def candidate_rows(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Coordinates as a WKT ``geometry`` column."""
    keep = [c for c in df.columns if c not in (lon, lat)]
    return df.select(*keep, to_wkt(F.col(lon), F.col(lat)).alias("geometry"))


def write_candidates(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    candidate_rows(df).write.mode("overwrite").option("header", True).format(fmt).save(path)


PLACEMARK_LABELS = {"name": "Name", "score": "Score", "water_type": "Water type", "dist_km": "Distance to water (km)", "occ_pct": "Water occurrence (%)", "at": "Position"}


def placemark_rows(df: DataFrame, labels: dict[str, str] = PLACEMARK_LABELS) -> DataFrame:
    """Name, HTML description, style and coordinates of each candidate (``name, score, water_type, dist_km, occ_pct``).

    The description is a table with one line per entry of ``labels`` (field to caption).
    """
    score = F.col("score")
    shown = {
        "score": F.format_string("%.3f", score), "dist_km": F.format_string("%.1f", "dist_km"), "occ_pct": F.format_string("%.1f", "occ_pct"),
        "at": F.format_string("%.6f, %.6f", "lat", "lon")}
    cells = [F.concat(F.lit(f"<tr><th>{caption}</th><td>"), shown[field] if field in shown else F.col(field), F.lit("</td></tr>")) for field, caption in labels.items()]
    html = F.concat(F.lit("<table>"), F.concat_ws("", *cells), F.lit("</table>"))
    style = F.when(score > 0.6, "high").when(score >= 0.5, "mid").otherwise("low")
    return df.withColumns({
        "title": F.format_string("候補地 (スコア: %.3f)", score),
        "description": html,
        "style_url": F.concat(F.lit("#candidate_"), style, F.lit("_style")),
        "coordinates": F.concat(F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",0")),
    })


def append_trials(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split and region."""
    df.write.mode("overwrite").partitionBy("split", "region").parquet(path)


def content_mark(df: DataFrame) -> str:
    """A mark of the rows of a table, whatever their order: schema, number, and sums of two hashes of the rows. One pass, two numbers to the driver."""
    comparable = lambda f: F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
    cols = [comparable(f) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    one = F.xxhash64(*cols)
    r = df.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(38,0)")), F.sum(F.xxhash64(one, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{sorted(f.simpleString() for f in df.schema.fields)}:{r[0]}:{r[1]}:{r[2]}"


def precompute_cached(spark: SparkSession, root: str, cfg: dict, build: Callable[[], DataFrame], inputs: Sequence[DataFrame] = ()) -> DataFrame:
    """Table for a configuration and its ``inputs``, built once; the folder is named by 12 hex digits of the md5 of the configuration and of what the
    inputs hold, so changed rows are not answered by an old table."""
    text = json.dumps(cfg, sort_keys=True, ensure_ascii=False) + "".join(f"|{content_mark(df)}" for df in inputs)
    key = hashlib.md5(text.encode()).hexdigest()[:12]
    path = f"{root.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
