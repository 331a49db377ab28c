"""Candidate columns: typing, occurrence estimate, scores, classes, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.functions import text
from toposcan.operators import multipattern
from toposcan.operators.ordered import quantiles, top_k

# Share of the distance estimate by toponym type, and the base used without a distance.
OCCURRENCE_SHARE = {"rio": 1.0, "igarape": 0.8, "lagoa": 0.6, "parana": 0.9, "porto": 0.4}
OCCURRENCE_BASE = {"rio": 50.0, "igarape": 30.0, "lagoa": 40.0, "parana": 45.0, "porto": 10.0}
OTHER_SHARE, OTHER_BASE = 0.5, 20.0
# Score parts.
MISSING_WEIGHT = 0.1


def _lookup(col: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return F.lit(default) if out is None else out.otherwise(default)


def clip(col: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def infer_type(df: DataFrame, roots: DataFrame, name: str = "normalized_name", max_roots: int = 64) -> DataFrame:
    """Add ``type``: category of the first dictionary root (by ``ord``) that is a substring of the name.

    The dictionary becomes one expression up to ``max_roots`` rows. A larger one is searched by automata over the distinct names
    (:mod:`toposcan.operators.multipattern`). Rows and columns are the same.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c != "type"]
    label = "category" if "category" in roots.columns else "root"
    first = roots.filter(F.col("root").isNotNull()).groupBy("root").agg(
        F.min_by(F.struct(F.col(label).alias("label")), "ord").alias("r"), F.min("ord").alias("ord"))
    known = first.select("root", "r.label", "ord").orderBy("ord").limit(max_roots + 1).collect()
    if len(known) <= max_roots:
        tries = [F.when(F.col(name).contains(r["root"]), F.lit(r["label"])) for r in known]
        return df.select(*columns, (F.coalesce(*tries) if tries else F.lit(None).cast("string")).alias("type"))
    df = df.drop("type")
    found = multipattern.first_contained(df.select(F.col(name).alias("text")), first.select(F.col("root").alias("pattern"), F.col("ord").alias("number")))
    best = found.join(first.groupBy(F.col("ord").alias("number")).agg(F.any_value("r.label").alias("type")), "number")
    return df.join(best.select(F.col("text").alias(name), "type"), name, "left").select(*columns, "type")


def estimate_occurrence(df: DataFrame, kind: str = "type", dist: str = "dist_km") -> DataFrame:
    """Add ``occ_pct`` from distance and type where no raster is at hand."""
    kind_col = F.col(kind)
    by_dist = F.greatest(F.lit(0.0), 100.0 * (1.0 - F.least(F.col(dist), F.lit(10.0)) / 10.0)) * _lookup(
        kind_col, OCCURRENCE_SHARE, OTHER_SHARE)
    base = _lookup(kind_col, OCCURRENCE_BASE, OTHER_BASE)
    return df.withColumn("occ_pct", F.when(F.col(dist).isNull(), base).otherwise(by_dist))


def score_linear(df: DataFrame) -> DataFrame:
    """Add ``dist_score``, ``occ_score`` and ``total_score`` = 0.6 distance + 0.4 dryness."""
    return df.withColumns({
        "dist_score": F.least(F.col("dist_km"), F.lit(10.0)) / 10.0,
        "occ_score": 1.0 - F.least(F.col("occ_pct"), F.lit(100.0)) / 100.0,
    }).withColumn("total_score", 0.6 * F.col("dist_score") + 0.4 * F.col("occ_score"))


def weight_of(root: Column, weights: dict[str, float]) -> Column:
    return _lookup(root, weights, MISSING_WEIGHT)


def score_weighted(df: DataFrame, weights: dict[str, float], root: str = "root") -> DataFrame:
    """Add ``total_score`` = 0.6 root weight + 0.3 closeness + 0.1 dryness."""
    near = clip(20.0 - F.col("dist_km"), 0.0, 20.0) / 20.0
    dry = clip(20.0 - F.col("occ_pct"), 0.0, 20.0) / 20.0
    return df.withColumn("total_score", 0.6 * weight_of(F.col(root), weights) + 0.3 * near + 0.1 * dry)


def review_flags(df: DataFrame, score: str = "water_score", threshold: float = 0.85) -> DataFrame:
    conf = clip(1.2 * F.col(score), 0.0, 1.0)
    return df.withColumn("confidence", conf).withColumn("needs_review", F.col("confidence") < threshold)


def classify_distance(df: DataFrame, threshold_km: float = 3.0) -> DataFrame:
    return df.withColumn("dist_class", F.when(F.col("dist_km") >= threshold_km, "far").otherwise("near"))


def classify_occurrence(df: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    return df.withColumn("occ_class", F.when(F.col("occ_pct") < threshold_pct, "dry").otherwise("wet"))


def bucketize(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], out: str) -> DataFrame:
    """Right-closed ranges; the lowest edge itself and what lies outside gets null."""
    expr = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = (F.col(col) > lo) & (F.col(col) <= hi) if hi != float("inf") else F.col(col) > lo
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return df.withColumn(out, expr)


def paleo_candidates(df: DataFrame, min_km: float = 3.0, max_occ: float = 5.0) -> DataFrame:
    """Far from rivers and drier than ``max_occ`` (strictly)."""
    return df.filter((F.col("dist_km") >= min_km) & (F.col("occ_pct") < max_occ)).withColumn("is_candidate", F.lit(True))


def threshold_top(df: DataFrame, min_km: float, max_occ: float, weights: dict[str, float], k: int = 20,
                  tie: str = "cand_id") -> DataFrame:
    """Sweep form: ``occ <= max_occ`` is kept; weighted score; the k best."""
    kept = df.filter((F.col("dist_km") >= min_km) & (F.col("occ_pct") <= max_occ))
    return top_k(score_weighted(kept, weights), "total_score", k, tie)


def top_quantile(df: DataFrame, col: str, q: float = 0.7) -> DataFrame:
    """Rows at or above the exact quantile of ``col``."""
    return df.filter(F.col(col) >= quantiles(df, col, {"q": q}).scalar())


def filter_by_vocab(df: DataFrame, pattern: str, cols: Sequence[str] = text.NAME_COLS) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.filter(text.any_of([F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in present]))


# Tags of present-day water.
WATER_TAGS = ["waterway", "natural", "water", "wetland", "riverbank"]


def drop_water_features(df: DataFrame, tags: str | None = None) -> DataFrame:
    """Drop rows with a present-day water tag, from tag columns or a tag map."""
    checks = [F.col(c).isNull() for c in WATER_TAGS if c in df.columns]
    if tags:
        keys = F.array(*[F.lit(t) for t in WATER_TAGS])
        checks.append(~F.coalesce(F.arrays_overlap(F.map_keys(tags), keys), F.lit(False)))
    for c in checks:
        df = df.filter(c)
    return df


def tag_categories(df: DataFrame, patterns: dict[str, str], cols: Sequence[str] = text.NAME_COLS) -> DataFrame:
    """Add ``root_categories`` and ``root_category`` (the first); rows without a match are dropped.

    With the category ``all`` nothing is filtered.
    """
    if "all" in patterns:
        return df.withColumns({"root_categories": F.array(F.lit("all")), "root_category": F.lit("all")})
    present = [F.col(c) for c in cols if c in df.columns]
    tagged = df.withColumn("root_categories", text.matched_categories(present, patterns))
    tagged = tagged.filter(F.size("root_categories") > 0)
    return tagged.withColumn("root_category", F.element_at("root_categories", 1))


def root_patterns(roots: DataFrame, categories: Sequence[str] | None = None) -> dict[str, str]:
    """One whole-word pattern per category from a root dictionary, for expressions; the dictionary's tokens are the pattern.

    :func:`root_token_table` has the tokens as rows.
    """
    d = roots.filter(F.col("regex_token").isNotNull())
    if categories is not None:
        d = d.filter(F.col("category").isin(list(categories)))
    first = d.groupBy("category", "regex_token").agg(F.min("ord").alias("ord"))
    rows = first.orderBy("category", "ord").collect()
    tokens: dict[str, list[str]] = {}
    for r in rows:
        tokens.setdefault(r["category"], []).append(r["regex_token"])
    return {c: text.vocabulary_pattern(t) for c, t in tokens.items()}


def root_token_table(roots: DataFrame) -> DataFrame:
    """``category, ord, token``: the distinct tokens of each category with their first place in the dictionary."""
    named = roots.filter(F.col("regex_token").isNotNull())
    return named.groupBy("category", F.col("regex_token").alias("token")).agg(F.min("ord").alias("ord")).select("category", "ord", "token")


def year_window(df: DataFrame, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    if min_year is not None:
        df = df.filter(F.col("discovery_year") >= min_year)
    if max_year is not None:
        df = df.filter(F.col("discovery_year") <= max_year)
    return df


def by_culture(df: DataFrame, tag: str, sites: Sequence[str] | None = None) -> DataFrame:
    df = df.filter(F.col("culture_tag") == tag)
    return df.filter(F.col("site_name").isin(list(sites))) if sites else df


def in_bbox(df: DataFrame, bbox: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Inclusive box west, south, east, north; plain comparisons, so Parquet can skip row groups."""
    w, s, e, n = bbox
    return df.filter(F.col(lon).between(w, e) & F.col(lat).between(s, n))


def seed_water_flag(df: DataFrame, name: str = "name", feature_type: str = "feature_type",
                    seeds: Sequence[str] = tuple(text.WATER_SEEDS)) -> DataFrame:
    """Add ``is_water`` and ``water_score`` (1.0 or 0.1)."""
    flag = text.is_water_name(F.col(name), F.col(feature_type), seeds)
    return df.withColumn("is_water", flag).withColumn("water_score", F.when(F.col("is_water"), 1.0).otherwise(0.1))


def water_ratio(df: DataFrame) -> DataFrame:
    """Share of water names per table: one row."""
    return df.agg(
        F.count_if("is_water").alias("n_water"),
        F.coalesce(F.avg(F.col("is_water").cast("double")), F.lit(0.0)).alias("water_ratio"))
