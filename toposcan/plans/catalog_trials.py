"""Trial logs, failure analysis, proposals and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from toposcan.operators import failures, trials as tr
from toposcan.plans.catalog_metrics import SCORED, round_all
from toposcan.plans.catalog_names import WEIGHTS, _trial_json
from toposcan.plans.catalog_space import HITS, KNOWN_CAND
from toposcan.plans.registry import q6, query, r6, rounded
from toposcan.plans.views import d
from toposcan.session import scratch
from toposcan.sources import sinks
from toposcan.streaming import trials as stream

RUN = """(SELECT trial_id, score, row_number() OVER (ORDER BY trial_id) AS rank, count(*) OVER () AS n,
          max(score) OVER (ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS best, lag(score) OVER (ORDER BY trial_id) AS prev FROM {v_trial})"""


@query("win3_best_so_far", f"SELECT trial_id, rank, {q6('best')} AS best FROM {RUN}")
def _(v):
    return rounded(tr.best_so_far(v("v_trial").select("trial_id", "score")), "best").select("trial_id", "rank", "best")


@query("win3_running_best", f"""
    WITH r AS (SELECT *, n // 4 AS q FROM {RUN}),
    e AS (SELECT max(n) AS n, max(best) FILTER (WHERE rank = 1) AS f, max(best) FILTER (WHERE rank = n) AS l,
                 max(best) FILTER (WHERE rank = q) AS a, max(best) FILTER (WHERE rank = n - q + 1) AS z FROM r)
    SELECT n, {q6("l - f")} AS total_improvement, {q6("a - f")} AS early_improvement, {q6("l - z")} AS late_improvement FROM e""")
def _(v):
    return round_all(tr.running_best(v("v_trial")))


@query("win4_score_changes", f"""
    SELECT {q6("count(*) FILTER (WHERE score > prev) / (count(*) - 1)")} AS improvement_frequency, {q6("stddev_pop(score - prev)")} AS score_volatility,
           count(*) FILTER (WHERE score - prev > 0) AS positive_changes, count(*) FILTER (WHERE score - prev < 0) AS negative_changes,
           count(*) FILTER (WHERE abs(score - prev) < 1e-8) AS zero_changes FROM {RUN}""")
def _(v):
    return round_all(tr.score_changes(v("v_trial")))


@query("win5_stagnation_runs", f"""
    WITH b AS (SELECT trial_id, best, lag(best) OVER (ORDER BY trial_id) AS pb FROM {RUN}),
    g AS (SELECT trial_id, sum(CASE WHEN pb IS NULL OR best - pb >= 1e-6 THEN 1 ELSE 0 END) OVER (ORDER BY trial_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT CAST(run AS BIGINT) AS run, min(trial_id) AS first_trial, count(*) - 1 AS length FROM g GROUP BY run HAVING count(*) > 1""")
def _(v):
    return tr.stagnation_runs(v("v_trial"))


@query("win6_convergence_speed", f"""
    WITH e AS (SELECT arg_min(score, trial_id) AS f, max(score) AS b, count(*) AS n FROM {{v_trial}})
    SELECT {q6("(SELECT min(rank) - 1 FROM " + RUN + " WHERE score >= f + (b - f) * 0.5) / n")} AS convergence_speed FROM e""")
def _(v):
    return round_all(tr.convergence_speed(v("v_trial")))


@query("win7_trend", f"""
    WITH t AS (SELECT avg(score) FILTER (WHERE rank <= n // 3) AS a, avg(score) FILTER (WHERE rank > n * 2 // 3) AS b, stddev_pop(score) AS s FROM {RUN})
    SELECT {q6("a")} AS early_mean, {q6("b")} AS recent_mean, CASE WHEN b > a THEN 'improving' ELSE 'declining' END AS overall_trend,
           {q6("abs(b - a) / (s + 1e-8)")} AS trend_strength FROM t""")
def _(v):
    return round_all(tr.trend(v("v_trial")))


RECENT = """SELECT max(score) FILTER (WHERE n - rank < 5) AS recent_best, max(score) FILTER (WHERE n - rank BETWEEN 5 AND 9) AS earlier_best FROM """


@query("win8_recent_vs_earlier", f"""
    SELECT {q6("recent_best")} AS recent_best, {q6("earlier_best")} AS earlier_best, recent_best <= earlier_best AS stagnated FROM ({RECENT} {RUN})""")
def _(v):
    return round_all(tr.recent_vs_earlier(v("v_trial")))


@query("win9_weight_gain", f"""
    WITH w AS (SELECT trial_id, 'root' || CAST(root_no AS VARCHAR) AS root, weight AS w FROM {{v_trial}} UNION ALL
               SELECT trial_id, 'agua', 1 - weight FROM {{v_trial}}),
    l AS (SELECT root, w FROM w WHERE trial_id = (SELECT max(trial_id) FROM w))
    SELECT root, round_even(avg(w.w - coalesce(l.w, 0)), 3) AS avg_gain FROM w LEFT JOIN l USING (root)
    WHERE trial_id IN (SELECT trial_id FROM {{v_trial}} ORDER BY trial_id DESC LIMIT 20) GROUP BY root""")
def _(v):
    return tr.weight_gain(_trial_json(v).withColumnRenamed("id", "trial_id"))


OK_RUN = RUN.replace("FROM {v_trial})", "FROM {v_trial} WHERE status = 'completed')")


@query("trl1_trial_patterns", f"""
    SELECT count(*) AS n, {q6("count(*) FILTER (WHERE n_candidates = 0) / count(*)")} AS candidates_zero_rate,
           {q6("count(*) FILTER (WHERE score < 0) / count(*)")} AS negative_score_rate, {q6("max(score)")} AS best_score,
           {q6("min(score)")} AS min_score, {q6("avg(score)")} AS mean_score, {q6("stddev_pop(score)")} AS std_score,
           (SELECT recent_best <= earlier_best FROM ({RECENT} {OK_RUN})) AS convergence_issues
    FROM {{v_trial}} WHERE status = 'completed'""")
def _(v):
    return round_all(tr.trial_patterns(v("v_trial")))


def moment(c: str, k: int) -> str:
    return f"avg(pow({c} - m, {k})) / pow(avg(pow({c} - m, 2)), {k / 2})" + (" - 3" if k == 4 else "")


@query("trl2_trial_stats", f"""
    SELECT count(*) AS n, {q6("avg(score)")} AS score_mean, {q6("stddev_pop(score)")} AS score_std, {q6("min(score)")} AS score_min,
           {q6("max(score)")} AS score_max, {q6(moment("score", 3))} AS score_skewness, {q6(moment("score", 4))} AS score_kurtosis,
           {q6("avg(n_candidates)")} AS cand_mean, {q6("stddev_pop(n_candidates)")} AS cand_std, min(n_candidates) AS cand_min,
           max(n_candidates) AS cand_max, count(*) FILTER (WHERE n_candidates = 0) AS cand_zero,
           {q6("count(*) FILTER (WHERE n_candidates = 0) / count(*)")} AS cand_zero_rate,
           {q6("avg(n_candidates) FILTER (WHERE n_candidates > 0)")} AS cand_nonzero_mean, count(*) FILTER (WHERE score > 0) AS positive,
           count(*) FILTER (WHERE score < 0) AS negative, count(*) FILTER (WHERE score = 0) AS zero, {q6("corr(score, n_candidates)")} AS score_cand_corr,
           {q6("quantile_cont(score, 0.25)")} AS score_q25, {q6("quantile_cont(score, 0.5)")} AS score_median, {q6("quantile_cont(score, 0.75)")} AS score_q75,
           {q6("quantile_cont(CAST(n_candidates AS DOUBLE), 0.5)")} AS cand_median,
           {q6("quantile_cont(score, 0.75) - quantile_cont(score, 0.25)")} AS score_iqr
    FROM (SELECT *, avg(score) OVER () AS m FROM {{v_trial}})""")
def _(v):
    return round_all(tr.trial_stats(v("v_trial")))


def with_params(v):
    return v("v_trial").withColumn("params", F.create_map(
        F.lit("distance_km"), F.col("distance_km"), F.lit("occ_pct"), F.col("occ_pct"), F.lit("weight"), F.col("weight")))


def space(v):
    """Defined ranges: zero to twice the mean of each parameter, and none for the weight."""
    t = v("v_trial").agg(F.bround(F.avg("distance_km") * 4).alias("a"), F.bround(F.avg("occ_pct") * 4).alias("b"))
    return t.select(F.inline(F.array(
        F.struct(F.lit("distance_km").alias("name"), F.lit(0.0).alias("low"), F.col("a").alias("high")),
        F.struct(F.lit("occ_pct").alias("name"), F.lit(0.0).alias("low"), F.col("b").alias("high")))))


LONG_PARAMS = " UNION ALL ".join(f"SELECT trial_id, '{c}' AS name, {c} AS v FROM {{v_trial}}" for c in ("distance_km", "occ_pct", "weight"))
SPACE = """SELECT 'distance_km' AS name, 0.0e0 AS low, round_even(avg(distance_km) * 4, 0) AS high FROM {v_trial} UNION ALL
           SELECT 'occ_pct', 0.0e0, round_even(avg(occ_pct) * 4, 0) FROM {v_trial}"""


@query("trl3_param_exploration", f"""
    WITH p AS ({LONG_PARAMS}), s AS ({SPACE}),
    g AS (SELECT name, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx, count(DISTINCT v) AS u, count(*) AS n FROM p GROUP BY name),
    l AS (SELECT g.*, coalesce(low, mn) AS lo, coalesce(high, mx) AS hi FROM g LEFT JOIN s USING (name)),
    e AS (SELECT name, avg(CASE WHEN abs(v - lo) / (hi - lo) < 0.1 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN abs(v - hi) / (hi - lo) < 0.1 THEN 1 ELSE 0 END) AS b
          FROM p JOIN l USING (name) GROUP BY name)
    SELECT name, {q6("mean")} AS mean, {q6("std")} AS std, {q6("mn")} AS min, {q6("mx")} AS max, u AS unique_count, {q6("u / n")} AS unique_rate,
           {q6("(mx - mn) / (hi - lo)")} AS utilization, {q6("a")} AS near_min, {q6("b")} AS near_max FROM l JOIN e USING (name)""")
def _(v):
    return round_all(tr.param_exploration(with_params(v), space(v)))


@query("trl3_param_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {q6(f'corr({a}, {b})')} AS correlation FROM {{v_trial}}"
    for a, b in (("distance_km", "occ_pct"), ("distance_km", "weight"), ("occ_pct", "weight"))))
def _(v):
    return round_all(tr.param_correlations(with_params(v)))


@query("trl3_param_diversity", f"""
    SELECT u AS unique_combinations, {q6("u / n")} AS diversity_ratio, {q6("1 - u / n")} AS repetition_rate FROM (
      SELECT (SELECT count(*) FROM (SELECT DISTINCT distance_km, occ_pct, weight FROM {{v_trial}})) AS u, (SELECT count(*) FROM {{v_trial}}) AS n)""")
def _(v):
    return round_all(tr.param_diversity(with_params(v)))


@query("trl4_trial_quality", f"""
    SELECT count(*) AS total_trials, {q6("count(*) FILTER (WHERE status = 'completed') / count(*)")} AS completion_rate,
           {q6("count(*) FILTER (WHERE status = 'failed') / count(*)")} AS failure_rate, {q6("avg(duration)")} AS mean_duration,
           {q6("stddev_pop(duration)")} AS std_duration, {q6("min(duration)")} AS min_duration, {q6("max(duration)")} AS max_duration,
           count(error_message) AS error_count, count(DISTINCT error_message) AS unique_errors FROM {{v_trial}}""")
def _(v):
    return round_all(tr.trial_quality(v("v_trial")))


@query("trl4_top_errors", """
    SELECT error_message, count(*) AS n FROM {v_trial} WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def _(v):
    return tr.top_errors(v("v_trial"))


@query("trl5_count_bands", f"""
    SELECT CASE WHEN n_candidates = 0 THEN 'zero' WHEN n_candidates <= 5 THEN 'tiny' WHEN n_candidates <= 20 THEN 'small'
           WHEN n_candidates <= 100 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, {q6("avg(score)")} AS mean_score FROM {{v_trial}} GROUP BY 1""")
def _(v):
    return round_all(tr.count_bands(v("v_trial")))


FP = "SELECT 'root' || CAST(root_no AS VARCHAR) AS root, CAST(sum(n_candidates) AS BIGINT) AS n FROM {v_trial} GROUP BY 1"


@query("trl6_fp_root_ranking", f"SELECT * FROM ({FP}) ORDER BY n DESC, root LIMIT 10")
def _(v):
    return tr.fp_root_ranking(_trial_json(v))


@query("trl6_best_trials", f"SELECT trial_id AS id, {q6('score')} AS score FROM {{v_trial}} ORDER BY {{v_trial}}.score DESC, trial_id LIMIT 5")
def _(v):
    return tr.best_trials(_trial_json(v).select("id", "score")).select("id", r6("score").alias("score"))


@query("trl6_history_stats", f"""
    SELECT count(*) AS n_trials, {q6("max(score)")} AS best_score, {q6("avg(score)")} AS avg_score, {q6("stddev_samp(score)")} AS score_std,
           {q6("min(distance_km)")} AS distance_min, {q6("max(distance_km)")} AS distance_max, {q6("min(occ_pct)")} AS occ_min,
           {q6("max(occ_pct)")} AS occ_max, count(DISTINCT root_no) + 1 AS unique_roots FROM {{v_trial}}""")
def _(v):
    return round_all(tr.history_stats(_trial_json(v)))


@query("trl7_trial_issues", f"""
    WITH t AS (SELECT *, -1 - score AS s FROM {{v_trial}}), t2 AS (SELECT * REPLACE (-1 - score AS score) FROM {{v_trial}}),
    p AS (SELECT count(*) FILTER (WHERE s < 0) / count(*) AS neg, max(s) AS best FROM t WHERE status = 'completed'),
    z AS (SELECT avg(s) FILTER (WHERE n_candidates % 3 = 0) AS zm, avg(s) FILTER (WHERE n_candidates % 3 <> 0) AS nm,
                 count(*) FILTER (WHERE n_candidates % 3 <> 0 AND status = 'completed') / count(*) FILTER (WHERE status = 'completed') AS zr FROM t)
    SELECT 'candidates_zero_frequent' AS issue_type, 'high' AS severity, {q6("zr")} AS value, 0.85e0 AS confidence FROM z WHERE zr >= 0.5 AND zr < 0.8
    UNION ALL SELECT 'candidates_zero_dominant', 'critical', {q6("zr")}, 0.95e0 FROM z WHERE zr >= 0.8
    UNION ALL SELECT 'negative_scores_dominant', 'critical', {q6("neg")}, 0.9e0 FROM p WHERE neg >= 0.6
    UNION ALL SELECT 'objective_function_design_flaw', 'critical', {q6("nm")}, 0.95e0 FROM p, z WHERE best <= 0 AND nm >= zm
    UNION ALL SELECT 'search_space_too_narrow', 'high', {q6("min(u)")}, 0.8e0 FROM (SELECT (max(distance_km) - min(distance_km)) / round_even(avg(distance_km) * 4, 0) AS u FROM t
        UNION ALL SELECT (max(occ_pct) - min(occ_pct)) / round_even(avg(occ_pct) * 4, 0) FROM t), z GROUP BY zr HAVING min(u) < 0.3 AND zr > 0.5
    UNION ALL SELECT 'convergence_stagnation', 'medium', {q6("best")}, 0.75e0 FROM p
      WHERE (SELECT recent_best <= earlier_best FROM ({RECENT} {RUN.replace('{v_trial}', 't2')}))
        AND (SELECT recent_best <= earlier_best FROM ({RECENT} {OK_RUN.replace('{v_trial}', 't2')}))""")
def _(v):
    """Trials turned bad: negated scores, two thirds without candidates."""
    t = with_params(v).withColumns({"score": -1 - F.col("score"), "n_candidates": F.when(F.col("n_candidates") % 3 == 0, 1).otherwise(0)})
    return round_all(tr.trial_issues(t, space(v)))


@query("trl8_validate_summary", f"""
    WITH c AS (SELECT count(*) AS n FROM {{v_trial}})
    SELECT 'trial_count_differs' AS issue_type, 'error' AS severity, {d("n")} AS value FROM c WHERE n <> 10
    UNION ALL SELECT 'more_successes_than_trials', 'error', {d("12")} UNION ALL SELECT 'objective_weights_zero', 'error', {d("0")}""")
def _(v):
    return tr.validate_summary(v("v_trial"), 10, 12, {"recall": 0.0})


GRID = "(SELECT DISTINCT distance_km AS d, occ_pct AS o FROM {v_trial})"


def grid(v):
    return v("v_trial").select(F.col("distance_km").alias("D"), F.col("occ_pct").alias("O")).distinct()


@query("jn16_sweep", f"""
    SELECT d AS "D", o AS "O", count(cand_id) AS n FROM {GRID} LEFT JOIN {{v_cand}} ON dist_km >= d AND {{v_cand}}.occ_pct <= o GROUP BY 1, 2""")
def _(v):
    return tr.sweep(v("v_cand"), grid(v))


SWEEP = f"""
    WITH s AS (SELECT cand_id, total_score, dist_km, occ_pct, cand_id IN ({HITS}) AS hit FROM {SCORED}),
    r AS (SELECT d, o, cand_id, CAST(hit AS INT) AS hit, row_number() OVER w AS rank, sum(CAST(hit AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS hits
          FROM {GRID} JOIN s ON s.dist_km >= d AND s.occ_pct <= o WINDOW w AS (PARTITION BY d, o ORDER BY total_score DESC, cand_id)),
    m AS (SELECT d, o, count(*) AS n, avg(hits / rank) AS map FROM r GROUP BY d, o),
    k AS (SELECT r.d, r.o, h.site_id, h.m, min(h.m) OVER (PARTITION BY r.d, r.o, h.site_id) AS best FROM r JOIN ({KNOWN_CAND}) h USING (cand_id)
          WHERE r.rank <= 100 AND h.m <= 500),
    c AS (SELECT d, o, count(*) AS matched FROM k WHERE m <= best + 1e-6 GROUP BY d, o),
    x AS (SELECT g.d, g.o, coalesce(n, 0) AS n, coalesce(matched, 0) / (SELECT count(*) FROM {{v_site}}) AS recall, coalesce(map, 0) AS map
          FROM {GRID} g LEFT JOIN m ON g.d = m.d AND g.o = m.o LEFT JOIN c ON g.d = c.d AND g.o = c.o)
    SELECT d AS "D", o AS "O", n AS n_candidates, {q6("recall", 9)} AS recall, {q6("map", 9)} AS map,
           {q6("CASE WHEN n = 0 THEN -0.05e0 ELSE 0.6e0 * recall + 0.2e0 * map - 0.1e0 * log10(n + 1) / log10(1001) END", 9)} AS composite_score FROM x"""


@query("trl9_sweep_metrics", SWEEP)
def _(v):
    return rounded(tr.sweep_metrics(v("v_cand"), v("v_site"), grid(v), WEIGHTS), "recall", "map", "composite_score", places=9)


# ---- failures ------------------------------------------------------------------------------------

WORDS = "(SELECT split_part(lower(name), ' ', 1) AS pattern, count(*) AS count FROM {v_cand} GROUP BY 1)"
OVER = f"""SELECT 'root_overrepresentation' AS type, pattern, count, CASE WHEN count < 10 THEN 'medium' ELSE 'high' END AS severity
           FROM {WORDS} WHERE count >= greatest(3, (SELECT count(*) FROM {{v_cand}}) * 0.1)"""
DENSE = """SELECT 'spatial_clustering' AS type, printf('%.1f, %.1f', la, lo) AS pattern, count(*) AS count, CASE WHEN count(*) < 10 THEN 'medium' ELSE 'high' END AS severity
           FROM (SELECT round_even(lon / 5 + 0.0003e0, 1) AS lo, round_even(lat / 5 + 0.0003e0, 1) AS la FROM {v_cand}) GROUP BY lo, la HAVING count(*) >= 5"""
FAR = """SELECT 'excessive_distance' AS type, 'far_from_rivers' AS pattern, count(*) AS count, CASE WHEN q < 10 THEN 'medium' ELSE 'high' END AS severity
         FROM {v_cand}, (SELECT quantile_cont(dist_km, 0.9) AS q FROM {v_cand}) WHERE dist_km > q AND q > 5 GROUP BY q"""
FRAG = """SELECT 'root_fragmentation' AS type, 'unique_patterns' AS pattern, count(*) AS count, 'medium' AS severity
          FROM (SELECT split_part(lower(name), ' ', 1) AS w FROM {} GROUP BY 1 HAVING count(*) = 1) HAVING count(*) > (SELECT count(*) FROM {}) * 0.3"""


def shifted(v):
    return v("v_cand").withColumns({"lon": F.col("lon") / 5 + 0.0003, "lat": F.col("lat") / 5 + 0.0003})


@query("txt5_overrepresented", OVER)
def _(v):
    return failures.overrepresented(v("v_cand"))


@query("txt6_fragmentation", FRAG.format("{v_site}", "{v_site}").replace("name)", "site_name)"))
def _(v):
    return failures.fragmentation(v("v_site").withColumnRenamed("site_name", "name"))


@query("rca1_dense_cells", DENSE)
def _(v):
    return failures.dense_cells(shifted(v))


@query("rca2_far_candidates", FAR)
def _(v):
    return failures.far_candidates(v("v_cand"))


ALL_FAILURES = f"{OVER} UNION ALL {DENSE} UNION ALL {FAR} UNION ALL {FRAG.format('{v_cand}', '{v_cand}')}"


@query("rca3_failure_groups", f"""
    SELECT type, count(*) AS n_failures, CAST(sum(count) AS BIGINT) AS total_count, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity
    FROM ({ALL_FAILURES}) GROUP BY type""")
def _(v):
    return failures.failure_groups(failures.find_failures(shifted(v)))


# ---- proposals -----------------------------------------------------------------------------------

ACTIONS = [("modify_prompt", 2), ("set_param", 3), ("add_root_weight", 5), ("add_exclude_mask", 7)]


def proposals(v):
    u = F.col("user_id")
    acts = F.array_compact(F.array(*[F.when(u % m == 0, F.lit(a)) for a, m in ACTIONS]))
    kind, val = F.col("event_type"), F.col("value").cast("string")
    effects = F.create_map(
        F.lit("recall@100"), F.concat(F.lit("+"), val, F.lit("%")), F.lit("workload"), F.when(kind == "view", F.concat(F.lit("-"), val)).otherwise(val),
        F.lit("api_cost"), F.when(kind == "error", F.concat(F.lit("+"), val)).otherwise("none"))
    return v("events").select(
        F.col("event_id").alias("prop_id"), F.concat(F.lit("Fix "), kind).alias("title"), acts.alias("actions"), effects.alias("effects"),
        F.when(u % 3 == 0, "high").when(u % 3 == 1, "medium").otherwise("low").alias("priority"),
        F.when(u % 4 == 0, "★★★").when(u % 4 == 1, "2 hours").when(u % 4 == 2, "10 min").otherwise("★☆☆").alias("effort"),
        F.when(u % 5 == 0, "High risk").when(u % 5 == 1, "moderate").when(u % 5 == 2, "API limits").otherwise("hard work").alias("risk"))


DIVERSITY = f"""
    WITH b AS (SELECT event_id, {", ".join(f"CAST(user_id % {m} = 0 AS INT) AS a{i}" for i, (_, m) in enumerate(ACTIONS))} FROM {{events}}),
    g AS (SELECT a0, a1, a2, a3, count(*) AS m FROM b GROUP BY ALL),
    j AS (SELECT x.a0, x.a1, x.a2, x.a3, sum(y.m * (x.a0*y.a0 + x.a1*y.a1 + x.a2*y.a2 + x.a3*y.a3) /
                 nullif(greatest(x.a0,y.a0) + greatest(x.a1,y.a1) + greatest(x.a2,y.a2) + greatest(x.a3,y.a3), 0)) AS s,
                 sum(CASE WHEN greatest(x.a0,y.a0) + greatest(x.a1,y.a1) + greatest(x.a2,y.a2) + greatest(x.a3,y.a3) > 0 THEN y.m ELSE 0 END) AS n,
                 x.a0 + x.a1 + x.a2 + x.a3 > 0 AS filled FROM g x, g y GROUP BY ALL),
    p AS (SELECT event_id, least(1, greatest(0, 1 - coalesce(CASE WHEN filled THEN (s - 1) / (n - 1) ELSE coalesce(s, 0) / nullif(n, 0) END, 0)
                 + CASE WHEN a0 + a3 > 0 THEN 0.2 ELSE 0 END)) AS dv FROM b JOIN j USING (a0, a1, a2, a3))"""


@query("rnk1_jaccard_diversity", f"{DIVERSITY} SELECT event_id AS prop_id, {q6('dv')} AS diversity_score FROM p")
def _(v):
    return rounded(failures.jaccard_diversity(proposals(v)), "diversity_score").select("prop_id", "diversity_score")


PSCORES = """
    SELECT event_id, least(1, greatest(0, least(0.4e0, value / 20) + CASE WHEN event_type = 'view' THEN least(0.2e0, value / 500) ELSE -least(0.1e0, value / 1000) END
             + CASE user_id % 3 WHEN 0 THEN 0.2e0 WHEN 1 THEN 0.1e0 ELSE 0 END)) AS imp,
           least(1, greatest(0, CASE user_id % 4 WHEN 0 THEN 0.2e0 WHEN 1 THEN 0.7e0 ELSE 1 END
             - CASE user_id % 5 WHEN 0 THEN 0.3e0 WHEN 1 THEN 0.1e0 WHEN 2 THEN 0.2e0 ELSE 0.15e0 END
             - CASE WHEN event_type = 'error' THEN least(0.2e0, value / 50) ELSE 0 END)) AS cost FROM {events}"""


@query("rnk2_proposal_scores", f"SELECT event_id AS prop_id, {q6('imp')} AS improvement_score, {q6('cost')} AS cost_score FROM ({PSCORES})")
def _(v):
    return rounded(failures.proposal_scores(proposals(v)), "improvement_score", "cost_score").select("prop_id", "improvement_score", "cost_score")


@query("rnk2_cluster_bonus", f"""SELECT event_id AS prop_id, {q6("least(1, imp + CASE WHEN user_id % 2 = 0 OR event_type = 'click' THEN 0.1e0 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.1e0 ELSE 0 END)")} AS improvement_score
    FROM ({PSCORES.replace("event_id, least(1, greatest(0,", "event_id, event_type, user_id, ((").replace(" ELSE 0 END)) AS imp", " ELSE 0 END)) AS imp", 1)})""")
def _(v):
    """Two failure groups; the rationale of every second user speaks of distance, titles of clicks name the first group."""
    p = proposals(v).join(v("events").select(F.col("event_id").alias("prop_id"), "user_id"), "prop_id")
    p = p.withColumn("rationale", F.when(F.col("user_id") % 2 == 0, "the Distance is wrong").otherwise("unclear"))
    scored = failures.proposal_scores(p, clusters=("click", "elsewhere"))
    return rounded(scored, "improvement_score").select("prop_id", "improvement_score")


@query("rnk3_rank_proposals", f"""{DIVERSITY},
    t AS (SELECT event_id, round(0.6e0 * imp + 0.2e0 * dv + 0.2e0 * cost, 6) AS total FROM ({PSCORES}) JOIN p USING (event_id))
    SELECT event_id AS prop_id, total AS total_score, row_number() OVER (ORDER BY total DESC, event_id) AS rank FROM t""")
def _(v):
    p = failures.proposal_scores(failures.jaccard_diversity(proposals(v)))
    d = p.withColumn("improvement_score", 0.6 * F.col("improvement_score") + 0.2 * F.col("diversity_score") + 0.2 * F.col("cost_score"))
    # equal totals must tie on both engines, so the rounded total is what is ranked
    d = d.withColumns({"improvement_score": r6("improvement_score"), "diversity_score": F.lit(0.0), "cost_score": F.lit(0.0)})
    return failures.rank_proposals(d, weights=(1.0, 0.0, 0.0)).select("prop_id", "total_score", "rank")


# ---- stream --------------------------------------------------------------------------------------

@query("str1_stream_trials", "SELECT root, (SELECT count(*) FROM {v_trial} t WHERE 'root' || CAST(t.root_no AS VARCHAR) = f.root) AS n_trials, n AS n_fp FROM (" + FP + ") f")
def _(v):
    """The trial log as a file stream; its totals equal the batch totals."""
    t = _trial_json(v)
    spark = t.sparkSession
    log, out = scratch(spark, "stream-log"), scratch(spark, "stream-out")
    sinks.append_trials(t, log)
    stream.run_to_table(stream.stream_trials(spark, log), out, scratch(spark, "stream-ckpt"))
    return spark.read.parquet(out)


@query("str1_stream_summary", f"SELECT count(*) AS n_trials, {q6('max(score)')} AS best_score, {q6('avg(score)')} AS avg_score FROM {{v_trial}}")
def _(v):
    """Count, best and mean score over the same stream."""
    t = _trial_json(v)
    spark = t.sparkSession
    log, out = scratch(spark, "stream-log"), scratch(spark, "stream-out")
    sinks.append_trials(t, log)
    stream.run_to_table(stream.stream_trials(spark, log), out, scratch(spark, "stream-ckpt"), fp=False)
    return rounded(spark.read.parquet(out), "best_score", "avg_score")
