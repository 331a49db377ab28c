"""User-facing flows made of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from toposcan.functions import geo, text
from toposcan.operators import (candidates as cand, components, dictionary, failures, grid, metrics, sampling, similarity, spatial, textmine,
                                trials, validate, vectors)
from toposcan.operators.aggregates import site_centers
from toposcan.operators.ordered import ordered
from toposcan.session import cut
from toposcan.sources.sinks import precompute_cached, prepare_export


def precandidates(features: DataFrame, rivers: DataFrame, roots: DataFrame, patterns: dict[str, str],
                  bbox: tuple[float, float, float, float] | None = None, cells: DataFrame | None = None,
                  raster: tuple[float, float, float] | None = None) -> DataFrame:
    """Named features with type, river distance and water occurrence, before any threshold.

    Without a raster (``cells`` and its west, north, size) the occurrence is estimated from distance and type.
    """
    d = cand.in_bbox(features, bbox) if bbox else features
    d = cand.drop_water_features(cand.tag_categories(d, patterns), "tags" if "tags" in d.columns else None)
    d = d.withColumn("name", text.best_name(F.col("tags") if "tags" in d.columns else None, d.columns)).filter(F.col("name").isNotNull())
    d = d.withColumn("normalized_name", text.normalize_name(F.col("name")))
    d = spatial.attach_distance(cand.infer_type(d, roots), rivers)
    return grid.sample_points(d, cells, *raster) if cells is not None else cand.estimate_occurrence(d)


def identify_candidates(pre: DataFrame, min_km: float = 3.0, max_occ: float = 5.0) -> DataFrame:
    """Thresholded candidates with linear scores."""
    return cand.score_linear(cand.paleo_candidates(pre, min_km, max_occ))


def precompute(root: str, cfg: dict, build: Callable[[], DataFrame], spark, inputs: Sequence[DataFrame] = ()) -> DataFrame:
    """The table before thresholds, built once per configuration and rows of ``inputs``."""
    return precompute_cached(spark, root, cfg, build, inputs)


def site_neighbourhood(sites: DataFrame, toponyms: DataFrame, rivers: DataFrame, radius_km: float, merge_m: float = 200.0,
                       river_km: float = 50.0) -> DataFrame:
    """Toponyms around merged sites in polar form, with the nearest river; export columns."""
    merged = components.merge_sites(components.cluster_sites(sites, merge_m)).select("cluster_id", "site_name", "lon", "lat", "culture_tag")
    near = spatial.toponyms_around(merged, toponyms, radius_km)
    name = dictionary.representative_name(near, "site_name")
    d = near.withColumns({"_a": F.bround("toponym_lat", 4), "_o": F.bround("toponym_lon", 4)})
    d = dictionary.dedupe(d, ["site_name", "toponym_name", "_a", "_o"], "first", "feature_id").drop("_a", "_o")
    d = d.withColumns({
        "angle": geo.polar_angle(F.col("toponym_lon") - F.col("site_lon"), F.col("toponym_lat") - F.col("site_lat")),
        "radius": geo.haversine_km(F.col("site_lat"), F.col("site_lon"), F.col("toponym_lat"), F.col("toponym_lon"))})
    d = d.join(name, "site_name", "left").withColumnsRenamed({"toponym_lon": "lon", "toponym_lat": "lat"})
    d = spatial.river_polar(d, rivers, river_km).withColumnsRenamed({"lon": "toponym_lon", "lat": "toponym_lat"})
    return prepare_export(d, ["site_name", "representative", "toponym_name", "feature_id", "angle", "radius", "river_angle", "river_radius",
                              "nearest_river", "culture_tag", "toponym_lat", "toponym_lon", "site_lat", "site_lon"])


def similarity_ranking(known_rows: DataFrame, cand_rows: DataFrame) -> DataFrame:
    """Candidates ranked by likeness to known sites, with their centres."""
    return dictionary.rank_with_location(similarity.rank_candidates(known_rows, cand_rows), site_centers(cand_rows))


def inspect(cands: DataFrame, known: DataFrame) -> DataFrame:
    return metrics.metric_status(metrics.all_metrics(cands, known))


def propose_roots(names: DataFrame, roots: DataFrame) -> DataFrame:
    """Unknown patterns of the names: what a reviewer is asked about."""
    return textmine.root_candidates(names, roots).filter("status = 'unknown'")


def grow_dictionary(existing: DataFrame, asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Dictionary extended by valid answers to asked patterns; ``answers`` are proposal rows keyed by ``root``."""
    valid = validate.validate_proposals(answers).filter(F.size("errors") == 0).drop("errors")
    picked = valid.join(asked.select(F.col("pattern").alias("root")), "root", "left_semi")
    return dictionary.merge_proposals(existing, picked)


def split_dataset(sites: DataFrame, bbox: tuple[float, float, float, float], year: int, val_ratio: float = 0.3, negative_ratio: float = 4.0,
                  min_km: float = 1.0) -> DataFrame:
    """Train, val and test_time splits of the positives plus negatives (split ``negative``), labelled."""
    pos = sampling.time_split(sites, year, val_ratio)
    neg = sampling.negative_samples(sites, bbox, negative_ratio, min_km).withColumn("split", F.lit("negative"))
    cols = ["site_name", "lat", "lon", "culture_tag", "discovery_year", "split"]
    both = pos.select(*cols).withColumn("is_positive", F.lit(True)).unionByName(neg.select(*cols).withColumn("is_positive", F.lit(False)))
    return both


def diagnose(cands: DataFrame, trial_log: DataFrame, space: DataFrame) -> DataFrame:
    """Failure groups of the candidates and issues of the trial log: ``area, kind, severity, value``."""
    f = failures.failure_groups(failures.find_failures(cands)).select(
        F.lit("candidates").alias("area"), F.col("type").alias("kind"), "severity", F.col("total_count").cast("double").alias("value"))
    t = trials.trial_issues(trial_log, space).select(F.lit("trials").alias("area"), F.col("issue_type").alias("kind"), "severity", "value")
    return f.unionByName(t)


def holdout_evaluation(cands: DataFrame, known: DataFrame, weights: dict[str, float], min_km: float, max_occ: float, k: int = 20,
                       max_m: float = 500.0, tie: str = "cand_id", site: str = "site_id") -> DataFrame:
    """Fixed parameters scored on every ``split, region`` of the known sites; gap to the row ``val, all``.

    The k best candidates are the same for all splits, so they meet all known sites in one join.
    """
    best = cut(ordered(cand.threshold_top(cands, min_km, max_occ, weights, k, tie), "total_score", tie, desc=True, splits=2))
    pts = spatial.with_planar(best, "utm21s").select(tie, "rank", "x", "y")
    sites = spatial.with_planar(known, "utm21s", x="x2", y="y2").select(F.col(site).alias("site"), "split", "region", "x2", "y2")
    pairs = spatial.near_pairs(pts, sites, max_m)
    groups = known.groupBy("split", "region").agg(F.count(F.lit(1)).alias("n_sites"))
    per_dist = pairs.groupBy("split", "region", "site", "dist").agg(F.count(F.lit(1)).alias("n"))
    matched = (per_dist.groupBy("split", "region", "site").agg(F.min_by("n", "dist").alias("n"))
               .groupBy("split", "region").agg(F.sum("n").alias("matched")))
    n_best = best.agg(F.count(F.lit(1))).scalar()
    hit_ranks = pairs.select("split", "region", "rank").distinct().groupBy("split", "region").agg(F.collect_set("rank").alias("ranks"))  # at most k
    d = groups.join(matched, ["split", "region"], "left").join(hit_ranks, ["split", "region"], "left").withColumn("n", n_best)
    hits_upto = lambda i: F.size(F.filter(F.coalesce("ranks", F.array().cast("array<bigint>")), lambda r: r <= i))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n")).cast("int"))
    total = F.aggregate(steps, F.lit(0.0), lambda s, i: s + hits_upto(i) / i)
    recall, map_ = F.coalesce(F.col("matched") / F.col("n_sites"), F.lit(0.0)), F.when(F.col("n") > 0, total / F.col("n")).otherwise(0.0)
    d = d.withColumns({"recall": recall, "map": map_}).withColumn("score", metrics.composite(F.col("recall"), F.col("map"), F.col("n")))
    val = d.filter("split = 'val'").agg(F.max("score")).scalar()
    d = d.withColumn("gap", F.col("score") - val)
    return d.select("split", "region", "n_sites", "recall", "map", "score", "gap", (F.abs("gap") > 0.1).alias("large_gap"))


def process_names(names: DataFrame, seeds: Sequence[str] = tuple(text.WATER_SEEDS), dim: int = 512, name: str = "name", key: str = "ord") -> DataFrame:
    """Normalised names with water score, confidence and review flag."""
    embed = vectors.hash_embedding(dim)
    norm = names.select(key, text.normalize_name(F.col(name)).alias("normalized_name"))
    # equal names have equal vectors: each is embedded and scored once
    vec = norm.select("normalized_name").distinct().select(F.xxhash64("normalized_name").alias("id"), embed("normalized_name").alias("v"))
    seed_rows = names.sparkSession.createDataFrame(list(enumerate(seeds)), "id BIGINT, word STRING")
    seed_vec = seed_rows.select("id", embed("word").alias("v"))
    scored = vectors.water_scores(vec, seed_vec, 3)
    joined = norm.withColumn("_id", F.xxhash64("normalized_name")).join(scored.withColumnRenamed("id", "_id"), "_id")
    return cand.review_flags(joined.drop("_id"))

