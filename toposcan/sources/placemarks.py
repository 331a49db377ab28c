"""Known sites from KMZ and KML files, many files in parallel."""

from __future__ import annotations

import io
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from toposcan.sources.readers import with_culture_from_path

SCHEMA = "path STRING, item INT, site_name STRING, lon DOUBLE, lat DOUBLE, description STRING"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(mark: ET.Element, name: str) -> str | None:
    for el in mark.iter():
        if _local(el.tag) == name and el.text and el.text.strip():
            return el.text.strip()
    return None


def _placemarks(content: bytes) -> Iterator[tuple]:
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".kml")]
            if not names:
                return
            content = z.read(names[0])
    n = 0
    for mark in ET.fromstring(content).iter():
        if _local(mark.tag) != "Placemark":
            continue
        parts = (_text(mark, "coordinates") or "").split(",")
        try:
            lon, lat = float(parts[0]), float(parts[1])
        except (IndexError, ValueError):
            continue
        yield n, _text(mark, "name") or f"site_{n:03d}", lon, lat, _text(mark, "description")
        n += 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows += [(path, *r) for r in _placemarks(bytes(content))]
            except (ET.ParseError, zipfile.BadZipFile):
                continue
        yield pd.DataFrame(rows, columns=["path", "item", "site_name", "lon", "lat", "description"])


def _broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                for _ in _placemarks(bytes(content)):
                    pass
            except (ET.ParseError, zipfile.BadZipFile) as e:
                rows.append((path, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "error"])


def unreadable_files(files: DataFrame) -> DataFrame:
    """``path, error`` of the files that :func:`parse_placemarks` cannot read."""
    return files.select("path", "content").mapInPandas(_broken, "path STRING, error STRING")


def parse_placemarks(files: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """Placemarks of files given as ``path, content``; points without readable coordinates are skipped.

    Files that cannot be read give no rows; :func:`unreadable_files` names them.
    """
    sites = files.select("path", "content").mapInPandas(_parse, SCHEMA)
    return with_culture_from_path(sites, F.col("path"), configured)


def read_placemarks(spark: SparkSession, glob: str, configured: tuple[str, ...] = ()) -> DataFrame:
    """Placemarks of all KMZ and KML files that match ``glob``."""
    return parse_placemarks(spark.read.format("binaryFile").load(glob), configured)
