"""Aggregations, features per site and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.functions import text
from toposcan.operators import aggregates as agg, candidates as cand, metrics
from toposcan.operators.ordered import rank_by, running_precision, top_k
from toposcan.plans.catalog_names import WEIGHTED, WEIGHTS, contains_sql, when_chain
from toposcan.plans.catalog_space import HITS, KNOWN_CAND
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.views import d


def round_all(df, *keep, places=6):
    """Round every double column."""
    return df.withColumns({c: r6(c, places) for c, t in df.dtypes if t == "double" and c not in keep})


def scored(v):
    return cand.score_weighted(v("v_cand"), WEIGHTS)


SCORED = f"(SELECT *, {WEIGHTED} AS total_score FROM {{v_cand}})"
# Ranks depend on the last bit of the score. Closeness and dryness are shares of 20 first and weighted then, as in score_weighted.
SCORED_SHARES = (f"(SELECT *, 0.6e0 * ({when_chain('root', WEIGHTS, 0.1)}) + 0.3e0 * (least(greatest(20 - dist_km, 0), 20) / 20)"
                 " + 0.1e0 * (least(greatest(20 - occ_pct, 0), 20) / 20) AS total_score FROM {v_cand})")


@query("agg1_value_counts", "SELECT root, count(*) AS n FROM {v_cand} GROUP BY root")
def _(v):
    return agg.value_counts(v("v_cand"), "root")


# ---- features per site ---------------------------------------------------------------------------

def quant(col: str, p: float) -> str:
    return f"quantile_cont({col}, {p})"


DISTANCE = {"min_distance": "min(radius)", "max_distance": "max(radius)", "mean_distance": "avg(radius)",
            "std_distance": "stddev_samp(radius)", "q25_distance": quant("radius", 0.25),
            "median_distance": quant("radius", 0.5), "q75_distance": quant("radius", 0.75),
            "iqr_distance": quant("radius", 0.75) + " - " + quant("radius", 0.25)}
RIVER = {"min_river_distance": "min(river_radius)", "mean_river_distance": "avg(river_radius)",
         "std_river_distance": "stddev_samp(river_radius)", "median_river_distance": quant("river_radius", 0.5),
         "river_angle_mean": "avg(river_angle)", "river_angle_std": "stddev_pop(river_angle)"}
RING, RATIO, INT_COLS = {}, {}, ["total_toponyms"]
for km in (1, 2, 3):
    RING[f"count_within_{km}km"] = f"count(*) FILTER (WHERE radius <= {km})"
    INT_COLS.append(f"count_within_{km}km")
    for c in agg.CATEGORIES:
        RING[f"{c}_count_{km}km"] = f"count(*) FILTER (WHERE radius <= {km} AND cat = '{c}')"
        INT_COLS.append(f"{c}_count_{km}km")
    RING[f"density_{km}km"] = f"count(*) FILTER (WHERE radius <= {km}) / (pi() * {km * km})"
for c in [*agg.CATEGORIES, "other"]:
    RATIO[f"{c}_ratio"] = f"count(*) FILTER (WHERE cat = '{c}') / count(*)"
QUAD = [f"count(*) FILTER (WHERE angle >= {90 * i} AND angle < {90 * (i + 1)})" for i in range(4)]
TOTAL = "(" + " + ".join(QUAD) + ")"
ANGLE = {"angle_mean": "avg(angle)", "angle_std": "stddev_pop(angle)", "angle_range": "max(angle) - min(angle)",
         **{f"quadrant_{i + 1}_count": q for i, q in enumerate(QUAD)},
         "angle_entropy": " + ".join(f"CASE WHEN {q} > 0 THEN -({q} / {TOTAL}) * log2({q} / {TOTAL}) ELSE 0 END" for q in QUAD)}
INT_COLS += [f"quadrant_{i + 1}_count" for i in range(4)]
SHAPE = {"distance_skewness": "avg(pow(radius - m, 3)) / pow(avg(pow(radius - m, 2)), 1.5)",
         "distance_kurtosis": "avg(pow(radius - m, 4)) / pow(avg(pow(radius - m, 2)), 2) - 3"}


def feature_sql(table: dict[str, str]) -> str:
    cat = "CASE " + " ".join(f"WHEN {contains_sql('lower(toponym_name)', w)} THEN '{c}'" for c, w in text.TOPONYM_CLASSES) + " ELSE 'other' END"
    cols = ", ".join(f"{e if k in INT_COLS else q6(e)} AS {k}" for k, e in table.items())
    return f"""SELECT site_name, {cols} FROM (SELECT *, {cat} AS cat, avg(radius) OVER (PARTITION BY site_name) AS m
               FROM {{v_site_toponym}}) GROUP BY site_name"""


FEATURES = {"total_toponyms": "count(*)", **DISTANCE, **RIVER, **RING, **ANGLE, **RATIO, **SHAPE}

for name, fn, table in [
    ("agg2_distance_features", agg.distance_features, DISTANCE), ("agg3_river_features", agg.river_features, RIVER),
    ("agg4_ring_features", agg.ring_features, RING), ("agg5_angle_features", agg.angle_features, ANGLE),
    ("agg6_ratio_features", agg.ratio_features, RATIO), ("agg7_shape_features", agg.shape_features, SHAPE),
    ("agg8_feature_table", agg.engineer_features, FEATURES),
]:
    query(name, feature_sql(table))(lambda v, fn=fn: round_all(fn(v("v_site_toponym"))))


@query("agg9_site_centers", f"""
    SELECT site_name, {q6("avg(site_lat)")} AS center_lat, {q6("avg(site_lon)")} AS center_lon, count(*) AS n_toponyms
    FROM {{v_site_toponym}} GROUP BY site_name""")
def _(v):
    return round_all(agg.site_centers(v("v_site_toponym")))


@query("agg10_dataset_stats", f"""
    SELECT count(*) AS total, min(discovery_year) AS year_min, max(discovery_year) AS year_max, {q6("avg(discovery_year)")} AS
    year_mean, {q6("max(lat)")} AS north, {q6("min(lat)")} AS south, {q6("max(lon)")} AS east, {q6("min(lon)")} AS west FROM {{v_site}}""")
def _(v):
    return round_all(agg.dataset_stats(v("v_site")))


@query("agg11_dict_stats", f"""
    SELECT count(*) AS total_entries, count(DISTINCT canonical_name) AS unique_canonical, count(DISTINCT root) AS unique_roots,
           {q6("avg(TRY_CAST(confidence AS DOUBLE))")} AS avg_confidence FROM {{v_dict}}""")
def _(v):
    return round_all(agg.dict_stats(v("v_dict")))


@query("agg11_root_stats", "SELECT lang, count(*) AS total_roots, count(regex_token) AS with_token FROM {v_root} GROUP BY lang")
def _(v):
    return agg.root_stats(v("v_root"))


# ---- ranking metrics -----------------------------------------------------------------------------

RECALL = f"""
    WITH r AS (SELECT cand_id, row_number() OVER (ORDER BY total_score DESC, cand_id) AS rank FROM {SCORED}),
    p AS (SELECT k.k, h.site_id, h.m, min(h.m) OVER (PARTITION BY k.k, h.site_id) AS best
          FROM ({KNOWN_CAND}) h JOIN r USING (cand_id) JOIN (SELECT unnest([5, 10, 20, 50, 100]) AS k) k ON r.rank <= k.k
          WHERE h.m <= 500),
    c AS (SELECT k, count(*) AS matched FROM p WHERE m <= best + 1e-6 GROUP BY k)
    SELECT CAST(ks.k AS INT) AS k, CAST(coalesce(matched, 0) AS BIGINT) AS matched,
           {q6("coalesce(matched, 0) / (SELECT count(*) FROM {v_site})", 9)} AS recall
    FROM (SELECT unnest([5, 10, 20, 50, 100]) AS k) ks LEFT JOIN c ON c.k = ks.k"""


@query("agg12_recall_at_k", RECALL)
def _(v):
    return rounded(metrics.recall_at_k(scored(v), v("v_site")), "recall", places=9)


PRECISIONS = f"""
    SELECT cand_id, rank, hits, hits / rank AS precision FROM (
      SELECT cand_id, row_number() OVER w AS rank, sum(CAST(hit AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS hits
      FROM (SELECT cand_id, total_score, cand_id IN ({HITS}) AS hit FROM {SCORED})
      WINDOW w AS (ORDER BY total_score DESC, cand_id))"""


@query("agg13_map", f"SELECT {q6('avg(precision)', 9)} AS map FROM ({PRECISIONS})")
def _(v):
    return rounded(metrics.map_score(scored(v), v("v_site")), "map", places=9)


@query("win2_running_precision", f"SELECT cand_id, rank, CAST(hits AS BIGINT) AS hits, {q6('precision', 9)} AS precision FROM ({PRECISIONS.replace(SCORED, SCORED_SHARES)})")
def _(v):
    from toposcan.operators.spatial import is_hit

    flagged = is_hit(scored(v).select("cand_id", "total_score", "lon", "lat"), v("v_site"))
    return rounded(running_precision(flagged, "total_score", "cand_id", "is_hit"), "precision", places=9).select(
        "cand_id", "rank", "hits", "precision")


@query("agg14_workload", "SELECT count(*) AS workload FROM {v_cand}")
def _(v):
    return agg.workload(v("v_cand"))


ENTROPY = "SELECT -sum(n / t * ln(n / t)) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM {v_cand} GROUP BY root)"


@query("agg15_root_diversity", f"SELECT {q6('entropy', 9)} AS entropy FROM ({ENTROPY})")
def _(v):
    return rounded(agg.entropy(v("v_cand"), "root"), "entropy", places=9)


@query("agg16_spatial_distribution", f"""
    SELECT {q6("max(lon) - min(lon)")} AS bbox_width, {q6("max(lat) - min(lat)")} AS bbox_height, {q6("stddev_pop(lon)")} AS coord_std_x,
           {q6("stddev_pop(lat)")} AS coord_std_y, {q6("avg(lon)")} AS centroid_x, {q6("avg(lat)")} AS centroid_y FROM {{v_cand}}""")
def _(v):
    return round_all(agg.spatial_distribution(v("v_cand")))


ALL_METRICS = f"""
    WITH rec AS ({RECALL})
    SELECT 'recall@' || CAST(k AS VARCHAR) AS metric, recall AS value FROM rec
    UNION ALL SELECT 'map', {q6('avg(precision)', 9)} FROM ({PRECISIONS})
    UNION ALL SELECT 'workload', {d('count(*)')} FROM {{v_cand}}
    UNION ALL SELECT 'root_diversity', {q6('entropy', 9)} FROM ({ENTROPY})"""


@query("agg17_all_metrics", ALL_METRICS)
def _(v):
    return rounded(metrics.all_metrics(scored(v), v("v_site")), "value", places=9)


@query("prj30_metric_status", f"""
    SELECT metric, value, CASE
        WHEN metric LIKE 'recall@%' THEN CASE WHEN value >= 0.5 THEN 'good' WHEN value >= 0.3 THEN 'fair' ELSE 'poor' END
        WHEN metric = 'map' THEN CASE WHEN value >= 0.4 THEN 'good' WHEN value >= 0.2 THEN 'fair' ELSE 'poor' END
        WHEN metric = 'workload' THEN CASE WHEN value <= 500 THEN 'good' WHEN value <= 1000 THEN 'fair' ELSE 'poor' END
        WHEN metric = 'root_diversity' THEN CASE WHEN value >= 2 THEN 'good' WHEN value >= 1 THEN 'fair' ELSE 'poor' END END AS status
    FROM (SELECT CASE event_type WHEN 'click' THEN 'recall@' || CAST(event_id % 100 AS VARCHAR) WHEN 'view' THEN 'map' WHEN 'error'
          THEN 'workload' WHEN 'signup' THEN 'root_diversity' ELSE 'other' END AS metric,
          CASE WHEN event_type = 'error' THEN value * 3 ELSE value / 200 END AS value FROM {{events}})""")
def _(v):
    kind = F.col("event_type")
    metric = (F.when(kind == "click", F.concat(F.lit("recall@"), (F.col("event_id") % 100).cast("string"))).when(kind == "view", "map")
              .when(kind == "error", "workload").when(kind == "signup", "root_diversity").otherwise("other"))
    value = F.when(kind == "error", F.col("value") * 3).otherwise(F.col("value") / 200)
    return metrics.metric_status(v("events").select(metric.alias("metric"), value.alias("value")))


@query("agg18_composite_score", f"""
    SELECT trial_id, {q6("CASE WHEN n_candidates = 0 THEN -0.05e0 ELSE 0.6e0 * score + 0.2e0 * weight - 0.1e0 * log10(n_candidates + 1) / log10(1001) END")}
           AS composite_score FROM {{v_trial}}""")
def _(v):
    t = v("v_trial").select("trial_id", F.col("score").alias("recall"), F.col("weight").alias("map"), F.col("n_candidates").alias("workload"))
    return rounded(metrics.composite_score(t), "composite_score").select("trial_id", "composite_score")


@query("agg19_range_objective", f"""
    WITH c AS (SELECT count(*) AS n, stddev_samp(lat) AS sa, stddev_samp(lon) AS so, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0,
                      max(lon) AS o1 FROM {{v_cand}}),
    k AS (SELECT count(*) FILTER (WHERE lat BETWEEN a0 AND a1 AND lon BETWEEN o0 AND o1) / count(*) AS share FROM {{v_site}}, c),
    s AS (SELECT n, CASE WHEN n = 0 THEN 0 WHEN n < 50 THEN n / 50 WHEN n <= 500 THEN 1 ELSE greatest(0.1, 1 - (n - 500) / 1000) END AS b,
                 least(1, (sa + so) / 2) AS v, least(1, share * 2) AS u FROM c, k)
    SELECT n, {q6("b")} AS count_score, {q6("v")} AS diversity_score, {q6("u")} AS validation_score,
           {q6("0.4 * b + 0.3 * v + 0.3 * u")} AS objective FROM s""")
def _(v):
    return round_all(metrics.range_objective(v("v_cand"), v("v_site")))


@query("agg20_polar_summary", f"""
    SELECT count(*) AS total_toponyms, {", ".join(f"{q6(f'{f}({c})')} AS {c}_{n}" for c in ("angle", "radius") for f, n in
           (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std")))},
           {", ".join(f"count(*) FILTER (WHERE least(floor(angle / 45), 7) = {i}) AS dir_{n}" for i, n in enumerate(agg.DIRECTIONS))},
           {", ".join(f"count(*) FILTER (WHERE least(floor(radius * 5 / top), 4) = {i}) AS ring_{i + 1}" for i in range(5))}
    FROM (SELECT *, max(radius) OVER () AS top FROM {{v_site_toponym}})""")
def _(v):
    return round_all(agg.polar_summary(v("v_site_toponym")))


@query("agg21_river_summary", f"""
    SELECT (SELECT count(*) FROM {{v_site_toponym}}) AS total_toponyms, count(*) AS valid_river_distances,
           {q6("count(*) / (SELECT count(*) FROM {v_site_toponym})")} AS coverage_rate,
           {", ".join(f"{q6(f'{f}({c})')} AS {c}_{n}" for c in ("river_angle", "river_radius") for f, n in
           (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std")))},
           {", ".join(f"count(*) FILTER (WHERE river_radius >= {lo} AND river_radius {'<=' if i == 4 else '<'} {hi}) AS bin_{i + 1}"
                      for i, (lo, hi) in enumerate([(0, 1), (1, 5), (5, 10), (10, 20), (20, 50)]))}
    FROM {{v_site_toponym}} WHERE river_radius <= 50""")
def _(v):
    return round_all(agg.river_summary(v("v_site_toponym"), 50.0))


@query("agg21_top_rivers", """
    SELECT nearest_river, count(*) AS n FROM {v_site_toponym} WHERE river_radius <= 50 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def _(v):
    return agg.top_rivers(v("v_site_toponym"))


@query("agg22_histogram", f"""
    WITH s AS (SELECT min(dist_km) AS lo, max(dist_km) AS hi FROM {{v_cand}}),
    c AS (SELECT CAST(least(floor((dist_km - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM {{v_cand}}, s GROUP BY 1)
    SELECT CAST(b AS INT) AS bin, {q6("lo + b * (hi - lo) / 20")} AS lower, {q6("lo + (b + 1) * (hi - lo) / 20")} AS upper, coalesce(n, 0) AS n
    FROM range(20) t(b) CROSS JOIN s LEFT JOIN c ON c.bin = b""")
def _(v):
    return round_all(agg.histogram(v("v_cand"), "dist_km", 20))


@query("agg23_summarize", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {q6(f'avg({c})')} AS mean, {q6(f'max({c})')} AS max, {q6(f'min({c})')} AS min,
        {q6(f'stddev_samp({c})')} AS std, {q6(f'quantile_cont({c}, 0.5)')} AS median FROM {{v_cand}}""" for c in ("dist_km", "occ_pct")))
def _(v):
    return round_all(agg.summarize(v("v_cand"), ["dist_km", "occ_pct"]))


@query("agg23_dashboard", f"""
    SELECT dataset, count(*) AS n, {q6("avg(total_score)")} AS mean_score, {q6("max(total_score)")} AS max_score,
           {q6("avg(dist_km)")} AS mean_distance, {q6("avg(occ_pct)")} AS mean_occurrence
    FROM (SELECT 'all' AS dataset, * FROM {SCORED} UNION ALL SELECT 'rio', * FROM {SCORED} WHERE root = 'rio') GROUP BY dataset""")
def _(v):
    s = scored(v)
    return round_all(agg.dashboard({"all": s, "rio": s.filter("root = 'rio'")}))


@query("agg24_root_score_stats", f"""
    SELECT root, count(total_score) AS n, {q6("avg(total_score)")} AS mean, {q6("coalesce(stddev_samp(total_score), 0)")} AS std
    FROM {SCORED} GROUP BY root""")
def _(v):
    return round_all(agg.root_score_stats(scored(v)))


@query("agg25_pair_corr", f"""
    SELECT {q6("corr(dist_km, total_score)")} AS dist_km_total_score, {q6("corr(occ_pct, total_score)")} AS occ_pct_total_score,
           {q6("corr(dist_km, occ_pct)")} AS dist_km_occ_pct FROM {SCORED}""")
def _(v):
    return round_all(agg.pair_corr(scored(v), [("dist_km", "total_score"), ("occ_pct", "total_score"), ("dist_km", "occ_pct")]))


ST_COLS = "site_name toponym_name radius angle river_radius river_angle nearest_river culture site_lat site_lon".split()


@query("agg26_null_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM {{v_site_toponym}}" for c in ST_COLS))
def _(v):
    return agg.null_counts(v("v_site_toponym"))


# ---- classification, regression, grids -----------------------------------------------------------

CONFUSION = ("count(*) FILTER (WHERE truth = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE truth = 0 AND score >= 0.5) AS fp, "
             "count(*) FILTER (WHERE truth = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE truth = 1 AND score < 0.5) AS fn")


@query("agg27_binary_metrics", f"""
    WITH c AS (SELECT {CONFUSION} FROM {{v_binary}}),
    r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM {{v_binary}}),
    a AS (SELECT (sum(rk) FILTER (WHERE truth = 1) - p * (p + 1) / 2) / (p * q) AS auc
          FROM r, (SELECT sum(truth) AS p, count(*) - sum(truth) AS q FROM {{v_binary}}) GROUP BY p, q)
    SELECT tp, fp, tn, fn, {q6("auc")} AS auc, {q6("(tp + tn) / (tp + tn + fp + fn)")} AS accuracy, {q6("tp / (tp + fp)")} AS precision,
           {q6("tp / (tp + fn)")} AS recall, {q6("2 * tp / (2 * tp + fp + fn)")} AS f1 FROM c, a""")
def _(v):
    return round_all(metrics.binary_metrics(v("v_binary")))


@query("agg28_regression_metrics", f"""
    SELECT {q6("avg(pow(y_true - y_pred, 2))", 9)} AS mse, {q6("avg(abs(y_true - y_pred))", 9)} AS mae,
           {q6("sqrt(avg(pow(y_true - y_pred, 2)))", 9)} AS rmse,
           {q6("1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true)", 9)} AS r2 FROM {{v_binary}}""")
def _(v):
    return round_all(metrics.regression_metrics(v("v_binary")), places=9)


@query("agg29_iou", f"""
    SELECT {q6("count(*) FILTER (WHERE truth = 1 AND score >= 0.5) / count(*) FILTER (WHERE truth = 1 OR score >= 0.5)")} AS iou FROM {{v_binary}}""")
def _(v):
    return round_all(metrics.iou(v("v_binary"), 0.5, "truth", "score"))


@query("agg29_dice", f"""
    SELECT {q6("2 * count(*) FILTER (WHERE truth = 1 AND score >= 0.5) / (sum(truth) + count(*) FILTER (WHERE score >= 0.5))")} AS dice FROM {{v_binary}}""")
def _(v):
    return round_all(metrics.dice(v("v_binary"), 0.5, "truth", "score"))


CELLS = "SELECT row, col, avg(value) AS mean, stddev_pop(value) AS std FROM {v_member} GROUP BY row, col"


@query("agg30_ensemble_cells", f"SELECT row, col, {q6('mean')} AS mean, {q6('std')} AS std, {q6('std / mean')} AS cv FROM ({CELLS})")
def _(v):
    return round_all(metrics.ensemble_cells(v("v_member")))


@query("agg30_ensemble_errors", f"""
    SELECT {q6("avg(pow(value - mean, 2))", 3)} AS mse, {q6("avg(abs(value - mean))", 3)} AS mae, {q6("sqrt(avg(pow(value - mean, 2)))", 3)} AS rmse
    FROM {{v_grid}} JOIN ({CELLS}) USING (row, col)""")
def _(v):
    return round_all(metrics.ensemble_errors(v("v_member"), v("v_grid").select("row", "col", F.col("value").alias("truth"))), places=3)


@query("agg31_hit_rate", f"""
    WITH h AS (SELECT DISTINCT row, col FROM {{v_cell}} WHERE value >= 50 AND value <> 255),
    s AS (SELECT CAST(floor((lon + 74) / 0.1e0) AS BIGINT) AS c, CAST(floor((-5 - lat) / 0.1e0) AS BIGINT) AS r FROM {{v_site}})
    SELECT CAST(count(h.row) AS BIGINT) AS hits, count(*) AS total_sites, {q6("count(h.row) / count(*)")} AS hit_rate
    FROM s LEFT JOIN h ON h.row = s.r AND h.col = s.c""")
def _(v):
    return round_all(metrics.hit_rate(v("v_site"), v("v_cell").filter("value <> 255"), 50.0, -74.0, -5.0, 0.1))


@query("agg32_priority_metrics", f"""
    WITH g AS (SELECT *, x1 - 0.3e0 AS minx, y1 - 0.3e0 AS miny, x1 + 0.3e0 AS maxx, y1 + 0.3e0 AS maxy, ord_stra AS priority FROM {{v_river}}),
    i AS (SELECT priority, count(*) AS n FROM {{v_site}} JOIN g ON lon > minx AND lon < maxx AND lat > miny AND lat < maxy GROUP BY 1),
    p AS (SELECT priority, count(*) AS gc, sum((maxx - minx) * (maxy - miny)) AS area FROM g GROUP BY 1),
    m AS (SELECT priority, coalesce(n, 0) AS sc, gc, gc / (SELECT count(*) FROM g) AS gr, coalesce(n, 0) / area AS sd,
                 coalesce(n, 0) / (SELECT count(*) FROM {{v_site}}) AS hr FROM p LEFT JOIN i USING (priority))
    SELECT priority, {q6("hr")} AS hit_rate, sc AS sites_count, gc AS grid_count, {q6("gr")} AS grid_ratio, {q6("sd")} AS site_density,
           {q6("hr / gr")} AS efficiency FROM m""")
def _(v):
    g = v("v_river").select(F.col("ord_stra").alias("priority"), (F.col("x1") - 0.3).alias("minx"), (F.col("y1") - 0.3).alias("miny"),
                            (F.col("x1") + 0.3).alias("maxx"), (F.col("y1") + 0.3).alias("maxy"))
    return round_all(metrics.priority_metrics(g, v("v_site"), 0.6))


@query("agg33_convergence", f"""
    SELECT count(*) AS iterations, {q6("arg_max(score, trial_id)")} AS final_error,
           {q6("1 - arg_max(score, trial_id) / arg_min(score, trial_id)")} AS convergence_rate FROM {{v_trial}}""")
def _(v):
    return round_all(metrics.convergence(v("v_trial"), "trial_id", "score"))


@query("agg34_cost", f"SELECT trial_id, {q6('0.4e0 * duration + 0.3e0 * (1 - weight) + 0.3e0 * (1 - score)')} AS cost FROM {{v_trial}}")
def _(v):
    t = v("v_trial").select("trial_id", F.col("duration").alias("dem_error"), F.col("weight").alias("iou"), F.col("score").alias("correlation"))
    return rounded(metrics.cost(t), "cost").select("trial_id", "cost")


@query("agg36_baseline_estimates", f"""
    WITH c AS (SELECT count(*) AS n, count(DISTINCT split_part(lower(name), ' ', 1)) AS w, (SELECT count(*) FROM {{v_site}}) AS k FROM {{v_cand}})
    SELECT {d("n")} AS workload, {q6("least(0.8, n / k * 0.3)")} AS recall_100, CASE WHEN n < 300 THEN 0.4e0 WHEN n < 800 THEN 0.3e0 ELSE 0.2e0 END
           AS map, {q6("w / n * 10", 9)} AS root_diversity FROM c""")
def _(v):
    out = agg.baseline_estimates(v("v_cand"), v("v_site"))
    return rounded(rounded(out, "recall_100"), "root_diversity", places=9)


@query("agg37_default_weights", """
    SELECT root, n, round_even(least(1, greatest(0.1e0, log10(n + 1) / 3)), 2) AS weight FROM
    (SELECT user_id % 400 AS root, count(*) AS n FROM {events} GROUP BY 1)""")
def _(v):
    counts = v("events").groupBy((F.col("user_id") % 400).alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return agg.default_weights(counts)


@query("agg38_estimated_root_counts", f"""
    SELECT ord, CAST(greatest(1, floor(CASE category WHEN 'water' THEN 15 WHEN 'terrain' THEN 8 WHEN 'flora' THEN 6 WHEN 'culture' THEN 4
           WHEN 'resource' THEN 3 ELSE 5 END * ({d("ord % 10")} / 9))) AS BIGINT) AS estimated
    FROM (SELECT ord, CASE ord % 6 WHEN 0 THEN 'water' WHEN 1 THEN 'terrain' WHEN 2 THEN 'flora' WHEN 3 THEN 'culture' WHEN 4 THEN 'resource'
          ELSE 'other' END AS category FROM {{v_root}})""")
def _(v):
    names = ["water", "terrain", "flora", "culture", "resource", "other"]
    category = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("ord") % 6 + 1).cast("int"))
    r = v("v_root").withColumns({"category": category, "weight": (F.col("ord") % 10) / F.lit(9.0)})
    return agg.estimated_root_counts(r, jitter=1.0).select("ord", "estimated")


@query("win1_rank", f"SELECT cand_id, row_number() OVER (ORDER BY total_score DESC, cand_id) AS rank FROM {SCORED_SHARES}")
def _(v):
    return rank_by(scored(v), "total_score", "cand_id").select("cand_id", "rank")


@query("top1_top_k", f"""
    SELECT cand_id, {q6("s")} AS total_score FROM (SELECT cand_id, {WEIGHTED} AS s FROM {{v_cand}}) ORDER BY s DESC, cand_id LIMIT 100""")
def _(v):
    return rounded(top_k(scored(v), "total_score", 100, "cand_id"), "total_score").select("cand_id", "total_score")
