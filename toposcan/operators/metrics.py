"""Evaluation of rankings, classifiers, regressions and grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.operators import aggregates, spatial
from toposcan.operators.ordered import ordered, running_precision, top_k
from toposcan.session import cut

KS = (5, 10, 20, 50, 100)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def recall_at_k(cands: DataFrame, known: DataFrame, ks: Sequence[int] = KS, max_m: float = 500.0,
                score: str = "total_score", tie: str = "cand_id", site: str = "site_id",
                distinct_known: bool = False) -> DataFrame:
    """``k, matched, recall``: known sites with one of the k best candidates within ``max_m``.

    A site at the same distance from several candidates counts once per candidate, so recall can
    exceed 1; ``distinct_known`` counts it once. Only the max(ks) best rows meet the sites.
    """
    best = ordered(top_k(cands, score, max(ks), tie), score, tie, desc=True, splits=2)
    best = spatial.with_planar(best, "utm21s").select("x", "y", "rank")
    sites = spatial.with_planar(known, "utm21s", x="x2", y="y2").select(F.col(site).alias("site"), "x2", "y2")
    pairs = spatial.near_pairs(best, sites, max_m).select("site", "rank", "dist")
    levels = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    per_dist = pairs.withColumn("k", F.explode(levels)).groupBy("k", "site", "dist").agg(F.count(F.lit(1)).alias("n"))
    per_site = per_dist.groupBy("k", "site").agg(F.min_by("n", "dist").alias("n"))
    matched = per_site.groupBy("k").agg((F.count(F.lit(1)) if distinct_known else F.sum("n")).alias("matched"))
    n_known = known.agg(F.count(F.lit(1))).scalar()
    frame = known.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return frame.join(matched, "k", "left").select(
        "k", F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"),
        _ratio(F.coalesce("matched", F.lit(0)), n_known).alias("recall"))


def map_score(cands: DataFrame, known: DataFrame, max_m: float = 500.0, score: str = "total_score",
              tie: str = "cand_id", average_precision: bool = False) -> DataFrame:
    """Mean precision over all ranks; ``average_precision`` averages over the hits only."""
    flagged = spatial.is_hit(cands.select(tie, score, "lon", "lat"), known, max_m)
    run = running_precision(cut(flagged), score, tie, "is_hit")  # ranking reads its input three times
    if average_precision:
        run = run.filter("is_hit")
    return run.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("map"))


def composite(recall: Column, map_: Column, n: Column, w_max: int = 1000) -> Column:
    """0.6 recall + 0.2 mAP - 0.1 log workload; -0.05 without candidates."""
    penalty = F.log10(n + 1.0) / F.log10(F.lit(w_max + 1.0))
    return F.when(n == 0, -0.05).otherwise(0.6 * recall + 0.2 * map_ - 0.1 * penalty)


def composite_score(df: DataFrame) -> DataFrame:
    """Add ``composite_score`` to metric rows ``recall, map, workload``."""
    return df.withColumn("composite_score", composite(F.col("recall"), F.col("map"), F.col("workload")))


def all_metrics(cands: DataFrame, known: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """``metric, value`` rows: recall@k, map, workload, root_diversity."""
    recall = recall_at_k(cands, known, ks).select(F.format_string("recall@%d", F.col("k")).alias("metric"),
                                                  F.col("recall").alias("value"))
    rest = [
        map_score(cands, known).select(F.lit("map").alias("metric"), F.col("map").alias("value")),
        aggregates.workload(cands).select(F.lit("workload").alias("metric"), F.col("workload").cast("double").alias("value")),
        aggregates.entropy(cands, "root").select(F.lit("root_diversity").alias("metric"), F.col("entropy").alias("value")),
    ]
    return reduce(DataFrame.unionByName, rest, recall)


# Lower bounds of good and fair (for the workload: upper bounds).
STATUS_BANDS = {"recall": (0.5, 0.3), "map": (0.4, 0.2), "workload": (500, 1000), "root_diversity": (2.0, 1.0)}


def metric_status(df: DataFrame) -> DataFrame:
    """Add ``status`` (good, fair, poor) to ``metric, value`` rows; other metrics get null."""
    out = F.lit(None).cast("string")
    v, m = F.col("value"), F.col("metric")
    for name, (good, fair) in STATUS_BANDS.items():
        hit = m.startswith("recall@") if name == "recall" else m == name
        if name == "workload":
            band = F.when(v <= good, "good").when(v <= fair, "fair").otherwise("poor")
        else:
            band = F.when(v >= good, "good").when(v >= fair, "fair").otherwise("poor")
        out = F.when(hit, band).otherwise(out)
    return df.withColumn("status", out)


def range_objective(cands: DataFrame, known: DataFrame) -> DataFrame:
    """0.4 count band + 0.3 spread + 0.3 share of known sites inside the candidates' box (doubled, at most 1)."""
    stats = cands.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("lat").alias("s_lat"), F.stddev_samp("lon").alias("s_lon"),
        F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    box = stats.select(F.struct("lat0", "lat1", "lon0", "lon1").alias("b")).scalar()
    inside = (known.withColumn("_b", box)
              .agg(F.count_if(F.col("lat").between(F.col("_b.lat0"), F.col("_b.lat1"))
                              & F.col("lon").between(F.col("_b.lon0"), F.col("_b.lon1"))).alias("inside"),
                   F.count(F.lit(1)).alias("n_known")))
    d = aggregates.one_row(stats, inside)
    n = F.col("n")
    band = (F.when(n == 0, 0.0).when(n < 50, n / 50.0).when(n <= 500, 1.0)
            .otherwise(F.greatest(F.lit(0.1), 1.0 - (n - 500) / 1000.0)))
    spread = F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), (F.col("s_lat") + F.col("s_lon")) / 2.0))
    known_part = (F.when(F.col("n_known") == 0, 0.5).when(n == 0, 0.0)
                  .otherwise(F.least(F.lit(1.0), _ratio(F.col("inside"), F.col("n_known")) * 2.0)))
    return d.select(
        "n", band.alias("count_score"), spread.alias("diversity_score"), known_part.alias("validation_score"),
        (0.4 * band + 0.3 * spread + 0.3 * known_part).alias("objective"))


def binary_metrics(df: DataFrame, truth: str = "truth", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and ROC AUC (ties share their rank)."""
    pos, guess = F.col(truth) == 1, F.col(score) >= threshold
    counts = df.agg(F.count_if(pos & guess).alias("tp"), F.count_if(~pos & guess).alias("fp"),
                    F.count_if(~pos & ~guess).alias("tn"), F.count_if(pos & ~guess).alias("fn"))
    per_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"))
    run = ordered(per_score, "s", "s", sums={"cum_neg": "n_neg"})
    won = F.sum(F.col("n_pos") * (F.col("cum_neg") - F.col("n_neg") / 2.0))
    auc = run.agg(F.try_divide(won, F.sum("n_pos") * F.sum("n_neg")).alias("auc"))
    d = aggregates.one_row(counts, auc)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = d.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp),
                       "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", _ratio(2 * p * r, p + r))


def regression_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """MSE, MAE, RMSE and R2 (0 for a constant target)."""
    err = F.col(truth) - F.col(pred)
    d = df.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(truth).alias("_v"))
    return d.select("mse", "mae", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("_v") > 0, 1.0 - F.col("mse") / F.col("_v")).otherwise(0.0).alias("r2"))


def iou(df: DataFrame, t: float = 0.5, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    a, b = F.col(truth) >= t, F.col(pred) >= t
    return df.agg(_ratio(F.count_if(a & b), F.count_if(a | b)).alias("iou"))


def dice(df: DataFrame, t: float = 0.5, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    a, b = F.col(truth) >= t, F.col(pred) >= t
    return df.agg(_ratio(2 * F.count_if(a & b), F.count_if(a) + F.count_if(b)).alias("dice"))


def ensemble_cells(members: DataFrame, value: str = "value") -> DataFrame:
    """Mean, population deviation and coefficient of variation per cell."""
    d = members.groupBy("row", "col").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return d.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))


def ensemble_errors(members: DataFrame, truth: DataFrame, value: str = "value") -> DataFrame:
    """MSE, MAE and RMSE of the ensemble mean against ``row, col, truth``."""
    e = ensemble_cells(members, value).join(truth, ["row", "col"]).withColumn("e", F.col("truth") - F.col("mean"))
    return e.agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae")).withColumn("rmse", F.sqrt("mse"))


def hit_rate(sites: DataFrame, cells: DataFrame, t: float, west: float, north: float, size: float) -> DataFrame:
    """Share of sites on a cell with a prediction of at least ``t``; rows count southwards from ``north``."""
    s = sites.select(F.floor((F.col("lon") - west) / size).cast("bigint").alias("col"),
                     F.floor((north - F.col("lat")) / size).cast("bigint").alias("row"))
    # sites are counted per cell first: a crowded cell is one row in the join
    per_cell = s.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    hot = cells.filter(F.col("value") >= t).select("row", "col").distinct().withColumn("hot", F.lit(1))
    d = per_cell.join(hot, ["row", "col"], "left").agg(
        F.coalesce(F.sum(F.when(F.col("hot") == 1, F.col("n"))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_sites"))
    return d.withColumn("hit_rate", _ratio(F.col("hits"), F.col("total_sites")))


def priority_metrics(grid: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """Hit rate, count, grid share, density and efficiency per priority of a grid of boxes."""
    places = sites.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("_n"))
    inside = spatial.points_within_boxes(places, grid, size).groupBy("priority").agg(F.sum("_n").alias("sites_count"))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    per = grid.groupBy("priority").agg(F.count(F.lit(1)).alias("grid_count"), F.sum(area).alias("grid_area"))
    n_grid, n_sites = grid.agg(F.count(F.lit(1))).scalar(), sites.agg(F.count(F.lit(1))).scalar()
    d = per.join(inside, "priority", "left").withColumns({"_g": n_grid, "_s": n_sites})
    d = d.withColumn("sites_count", F.coalesce("sites_count", F.lit(0))).withColumns({
        "grid_ratio": _ratio(F.col("grid_count"), F.col("_g")), "hit_rate": _ratio(F.col("sites_count"), F.col("_s")),
        "site_density": _ratio(F.col("sites_count"), F.col("grid_area"))})
    return d.withColumn("efficiency", _ratio(F.col("hit_rate"), F.col("grid_ratio"))).select(
        "priority", "hit_rate", "sites_count", "grid_count", "grid_ratio", "site_density", "efficiency")


def convergence(df: DataFrame, iteration: str = "iteration", error: str = "error") -> DataFrame:
    """Number of iterations, last error and 1 - last / first."""
    first, last = F.min_by(error, iteration), F.max_by(error, iteration)
    n = F.count(F.lit(1))
    rate = F.when(n >= 2, 1.0 - F.when(first == 0, 0.0).otherwise(F.try_divide(last, first))).otherwise(0.0)
    return df.agg(n.alias("iterations"), last.alias("final_error"), rate.alias("convergence_rate"))


def cost(df: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Add ``cost`` from ``dem_error, iou, correlation``."""
    a, b, c = weights
    return df.withColumn("cost", a * F.col("dem_error") + b * (1.0 - F.col("iou")) + c * (1.0 - F.col("correlation")))
