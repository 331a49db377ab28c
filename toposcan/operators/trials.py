"""Analytics over a log of optimisation trials (``trial_id, score, n_candidates, status, ...``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.operators import metrics, spatial
from toposcan.operators.aggregates import one_row, value_counts
from toposcan.operators.candidates import score_weighted
from toposcan.operators.ordered import ordered, quantiles
from toposcan.session import cut


def _n() -> Column:
    return F.count(F.lit(1))


def best_so_far(trials: DataFrame) -> DataFrame:
    """Add ``rank`` (1..n by trial) and ``best``: the best score up to each trial."""
    return ordered(trials, "trial_id", "trial_id", maxs={"best": "score"})


def running_best(trials: DataFrame) -> DataFrame:
    """Total improvement, and that of the first and the last quarter: one row."""
    n = trials.agg(_n()).scalar()
    d = best_so_far(trials.select("trial_id", "score")).withColumn("_n", n).withColumn("_q", F.floor(F.col("_n") / 4))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("best")))
    d = d.agg(F.max("_n").alias("n"), F.max("_q").alias("q"), at(1).alias("first"), at(F.col("_n")).alias("last"),
              at(F.col("_q")).alias("early"), at(F.col("_n") - F.col("_q") + 1).alias("late"))
    gain = lambda a, b: F.when(F.col("q") > 0, F.col(a) - F.col(b)).otherwise(0.0)
    return d.select("n", (F.col("last") - F.col("first")).alias("total_improvement"),
                    gain("early", "first").alias("early_improvement"), gain("last", "late").alias("late_improvement"))


def score_changes(trials: DataFrame) -> DataFrame:
    """Improvement frequency, volatility and signs of the differences between consecutive trials."""
    d = ordered(trials.select("trial_id", "score"), "trial_id", "trial_id", lags={"prev": "score"})
    c = F.col("score") - F.col("prev")
    return d.agg(
        F.coalesce(F.try_divide(F.count_if(c > 0), _n() - 1), F.lit(0.0)).alias("improvement_frequency"),
        F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("score_volatility"),
        F.count_if(c > 0).alias("positive_changes"), F.count_if(c < 0).alias("negative_changes"),
        F.count_if(F.abs(c) < 1e-8).alias("zero_changes"))


def stagnation_runs(trials: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Runs of trials without a better score: ``run, first_trial, length``."""
    best = cut(best_so_far(trials.select("trial_id", "score")).select("trial_id", "best"))
    d = cut(ordered(best, "trial_id", "trial_id", lags={"prev": "best"}))
    d = d.withColumn("_new", F.when(F.col("prev").isNull() | (F.col("best") - F.col("prev") >= tolerance), 1).otherwise(0))
    d = ordered(d.drop("rank"), "trial_id", "trial_id", sums={"run": "_new"})
    runs = d.groupBy("run").agg(F.min("trial_id").alias("first_trial"), (_n() - 1).alias("length"))
    return runs.filter(F.col("length") > 0)


def convergence_speed(trials: DataFrame) -> DataFrame:
    """Position, as a share of all trials, of the first trial that brings half of the total improvement."""
    ends = trials.agg(F.struct(F.min_by("score", "trial_id").alias("first"), F.max("score").alias("best")).alias("e")).scalar()
    d = trials.select("trial_id", "score").withColumn("_e", ends)
    target = F.col("_e.first") + (F.col("_e.best") - F.col("_e.first")) * 0.5
    hit = d.agg(F.min(F.when((F.col("score") >= target) & (F.col("_e.best") > F.col("_e.first")), F.col("trial_id")))).scalar()
    d = d.withColumn("_hit", hit)
    share = F.try_divide(F.count_if(F.col("trial_id") < F.col("_hit")), _n())
    return d.agg(F.coalesce(share, F.lit(0.0)).alias("convergence_speed"))


def trend(trials: DataFrame) -> DataFrame:
    """Mean score of the first and the last third, direction and strength."""
    d = ordered(trials.select("trial_id", "score"), "trial_id", "trial_id").withColumn("_n", trials.agg(_n()).scalar())
    early, recent = F.col("rank") <= F.floor(F.col("_n") / 3), F.col("rank") > F.floor(F.col("_n") * 2 / 3)
    d = d.agg(F.avg(F.when(early, F.col("score"))).alias("early_mean"), F.avg(F.when(recent, F.col("score"))).alias("recent_mean"),
              F.stddev_pop("score").alias("_s"))
    diff = F.col("recent_mean") - F.col("early_mean")
    return d.select("early_mean", "recent_mean", F.when(diff > 0, "improving").otherwise("declining").alias("overall_trend"),
                    (F.abs(diff) / (F.col("_s") + 1e-8)).alias("trend_strength"))


def _last(trials: DataFrame, k: int) -> DataFrame:
    """The last k trials with ``back`` = 1 for the latest; k is a small constant."""
    last = trials.orderBy(F.desc("trial_id")).limit(k)
    return last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("trial_id"))))


def recent_vs_earlier(trials: DataFrame, scored_only: bool = True) -> DataFrame:
    """Best of the last five trials, best of the five before, and whether progress has stopped.

    ``scored_only`` looks at the last ten trials with a score; without it at the last ten of all, of which those without a
    score bring nothing.
    """
    trials = trials.filter(F.col("score").isNotNull()) if scored_only else trials
    d = _last(trials.select("trial_id", "score"), 10)
    d = d.agg(F.max(F.when(F.col("back") <= 5, F.col("score"))).alias("recent_best"),
              F.max(F.when(F.col("back") > 5, F.col("score"))).alias("earlier_best"), _n().alias("_n"))
    return d.select("recent_best", "earlier_best",
                    F.coalesce((F.col("_n") == 10) & (F.col("recent_best") <= F.col("earlier_best")), F.lit(False)).alias("stagnated"))


def weight_gain(trials: DataFrame, window: int = 20) -> DataFrame:
    """Mean weight of each root over the last trials, relative to the latest trial; three decimals."""
    last = _last(trials.select("trial_id", "weights"), window)
    latest = last.filter("back = 1").select("weights").scalar()
    d = last.withColumn("_latest", latest).select("_latest", F.explode("weights").alias("root", "w"))
    d = d.groupBy("root").agg(F.avg(F.col("w") - F.coalesce(F.try_element_at("_latest", "root"), F.lit(0.0))).alias("g"))
    return d.select("root", F.bround("g", 3).alias("avg_gain"))


def _completed(trials: DataFrame) -> DataFrame:
    return trials.filter((F.col("status") == "completed") & F.col("score").isNotNull())


def trial_patterns(trials: DataFrame) -> DataFrame:
    """Zero-candidate and negative-score rates, stagnation and score distribution of the completed trials.

    Without a completed trial nothing converges: that is a convergence issue too.
    """
    ok = _completed(trials)
    zero = F.coalesce(F.try_divide(F.count_if(F.col("n_candidates") == 0), _n()), F.lit(1.0))
    stats = ok.agg(
        _n().alias("n"), zero.alias("candidates_zero_rate"),
        F.coalesce(F.try_divide(F.count_if(F.col("score") < 0), _n()), F.lit(0.0)).alias("negative_score_rate"),
        F.max("score").alias("best_score"), F.min("score").alias("min_score"), F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"))
    return one_row(stats, recent_vs_earlier(ok).select(F.col("stagnated").alias("convergence_issues"))).withColumn(
        "convergence_issues", F.col("convergence_issues") | (F.col("n") == 0))


def trial_stats(trials: DataFrame) -> DataFrame:
    """Score and candidate-count statistics: one row."""
    s, c = F.col("score"), F.col("n_candidates")
    base = trials.agg(
        _n().alias("n"), F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"), F.min(s).alias("score_min"),
        F.max(s).alias("score_max"), F.coalesce(F.skewness(s), F.lit(0.0)).alias("score_skewness"),
        F.coalesce(F.kurtosis(s), F.lit(0.0)).alias("score_kurtosis"),
        F.avg(c).alias("cand_mean"), F.stddev_pop(c).alias("cand_std"), F.min(c).alias("cand_min"), F.max(c).alias("cand_max"),
        F.count_if(c == 0).alias("cand_zero"), (F.count_if(c == 0) / _n()).alias("cand_zero_rate"),
        F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("cand_nonzero_mean"),
        F.count_if(s > 0).alias("positive"), F.count_if(s < 0).alias("negative"), F.count_if(s == 0).alias("zero"),
        F.corr(s, c.cast("double")).alias("score_cand_corr"))
    q = quantiles(trials, "score", {"score_q25": 0.25, "score_median": 0.5, "score_q75": 0.75})
    m = quantiles(trials.withColumn("n_candidates", c.cast("double")), "n_candidates", {"cand_median": 0.5})
    return one_row(base, q, m).withColumn("score_iqr", F.col("score_q75") - F.col("score_q25"))


def _param_values(trials: DataFrame, params: str) -> DataFrame:
    return trials.select(F.explode(params).alias("name", "v")).filter(F.col("v").isNotNull())


def param_ranges(trials: DataFrame, space: DataFrame, params: str = "params") -> DataFrame:
    """One row per parameter: statistics, ends ``low, high`` of the defined range and the share of it that is used.

    ``space`` has ``name, low, high``; a parameter without a definition is measured by its own range.
    """
    stats = _param_values(trials, params).groupBy("name").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.countDistinct("v").alias("unique_count"), _n().alias("n"))
    lim = stats.join(F.broadcast(space), "name", "left") if _small(space) else stats.join(space, "name", "left")
    lim = lim.withColumns({"low": F.coalesce("low", "min"), "high": F.coalesce("high", "max")})
    return lim.withColumn("utilization", F.try_divide(F.col("max") - F.col("min"), F.col("high") - F.col("low")))


def param_exploration(trials: DataFrame, space: DataFrame, params: str = "params") -> DataFrame:
    """:func:`param_ranges` with the shares of values near both ends."""
    lim = cut(param_ranges(trials, space, params))
    # a few names hold all values: the ranges go to the values, which are not gathered by name
    bounds = lim.select("name", "low", "high")
    bounds = F.broadcast(bounds) if _small(bounds) else bounds
    width = F.col("high") - F.col("low")
    near = (_param_values(trials, params).join(bounds, "name").groupBy("name").agg(
        F.avg((F.try_divide(F.abs(F.col("v") - F.col("low")), width) < 0.1).cast("double")).alias("near_min"),
        F.avg((F.try_divide(F.abs(F.col("v") - F.col("high")), width) < 0.1).cast("double")).alias("near_max")))
    return lim.join(near, "name").select(
        "name", "mean", "std", "min", "max", "unique_count", (F.col("unique_count") / F.col("n")).alias("unique_rate"),
        "utilization", "near_min", "near_max")


def _small(df: DataFrame, rows: int = 10000) -> bool:
    return df.limit(rows + 1).count() <= rows


def param_correlations(trials: DataFrame, params: str = "params") -> DataFrame:
    """Pearson correlation per pair of parameters, over the trials that have both."""
    items = F.array_sort(F.map_entries(params))
    pairs = F.flatten(F.transform(items, lambda a: F.transform(
        F.filter(items, lambda b: b["key"] > a["key"]),
        lambda b: F.struct(a["key"].alias("a"), b["key"].alias("b"), a["value"].alias("x"), b["value"].alias("y")))))
    return trials.select(F.inline(pairs)).groupBy("a", "b").agg(F.corr("x", "y").alias("correlation"))


def param_diversity(trials: DataFrame, params: str = "params") -> DataFrame:
    """Share of distinct parameter combinations."""
    key = F.to_json(F.array_sort(F.map_entries(params)))
    d = trials.agg(F.countDistinct(key).alias("unique_combinations"), _n().alias("n"))
    ratio = F.try_divide(F.col("unique_combinations"), F.col("n"))
    return d.select("unique_combinations", ratio.alias("diversity_ratio"), (1.0 - ratio).alias("repetition_rate"))


def trial_quality(trials: DataFrame) -> DataFrame:
    err = F.nullif("error_message", F.lit(""))
    return trials.agg(
        _n().alias("total_trials"), (F.count_if(F.col("status") == "completed") / _n()).alias("completion_rate"),
        (F.count_if(F.col("status") == "failed") / _n()).alias("failure_rate"), F.avg("duration").alias("mean_duration"),
        F.stddev_pop("duration").alias("std_duration"), F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"), F.count(err).alias("error_count"), F.countDistinct(err).alias("unique_errors"))


def top_errors(trials: DataFrame, k: int = 5) -> DataFrame:
    return value_counts(trials.filter(F.col("error_message") != ""), "error_message").limit(k)


def count_band(c: Column) -> Column:
    return F.when(c == 0, "zero").when(c <= 5, "tiny").when(c <= 20, "small").when(c <= 100, "medium").otherwise("large")


def count_bands(trials: DataFrame) -> DataFrame:
    return trials.groupBy(count_band(F.col("n_candidates")).alias("band")).agg(_n().alias("n"), F.avg("score").alias("mean_score"))


def fp_root_ranking(trials: DataFrame, k: int = 10) -> DataFrame:
    """Roots with the most false positives over all trials."""
    long = trials.select(F.explode("fp_roots").alias("root", "n"))
    return long.groupBy("root").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "root").limit(k)


def best_trials(trials: DataFrame, m: int = 5) -> DataFrame:
    return trials.orderBy(F.desc("score"), "id").limit(m)


def history_stats(trials: DataFrame) -> DataFrame:
    """Counts, best and mean score, ranges and number of roots of a trial log (``id, D, O, score, weights``)."""
    base = trials.agg(
        _n().alias("n_trials"), F.max("score").alias("best_score"), F.avg("score").alias("avg_score"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"), F.min("D").alias("distance_min"),
        F.max("D").alias("distance_max"), F.min("O").alias("occ_min"), F.max("O").alias("occ_max"))
    roots = trials.select(F.explode(F.map_keys("weights")).alias("root")).agg(F.countDistinct("root").alias("unique_roots"))
    return one_row(base, roots)


def trial_issues(trials: DataFrame, space: DataFrame, params: str = "params") -> DataFrame:
    """Issue rows ``issue_type, severity, value, confidence`` by fixed rules."""
    p = trial_patterns(trials)
    by_zero = trials.agg(F.avg(F.when(F.col("n_candidates") == 0, F.col("score"))).alias("zero_mean"),
                         F.avg(F.when(F.col("n_candidates") > 0, F.col("score"))).alias("nonzero_mean"), _n().alias("n_all"))
    narrow = param_ranges(trials, space, params).agg(F.min("utilization").alias("least_used"))
    d = one_row(p, by_zero, narrow, recent_vs_earlier(trials, scored_only=False).select(F.col("stagnated").alias("stagnated_all")))
    zero, neg = F.col("candidates_zero_rate"), F.col("negative_score_rate")
    flaw = (F.col("best_score") <= 0) & (zero > 0) & (F.col("zero_mean") >= F.col("nonzero_mean"))
    rules = [
        ("candidates_zero_dominant", "critical", zero >= 0.8, zero, 0.95),
        ("candidates_zero_frequent", "high", (zero >= 0.5) & (zero < 0.8), zero, 0.85),
        ("negative_scores_dominant", "critical", neg >= 0.6, neg, 0.9),
        ("objective_function_design_flaw", "critical", flaw, F.col("zero_mean"), 0.95),
        ("search_space_too_narrow", "high", (F.col("least_used") < 0.3) & (zero > 0.5), F.col("least_used"), 0.8),
        ("convergence_stagnation", "medium", F.col("convergence_issues") & F.col("stagnated_all") & (F.col("n_all") >= 10),
         F.col("best_score"), 0.75),
    ]
    return _rule_rows(d, rules)


def _rule_rows(d: DataFrame, rules: list[tuple]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(i).alias("issue_type"), F.lit(s).alias("severity"), v.cast("double").alias("value"),
                 F.lit(float(c)).alias("confidence"), F.coalesce(cond, F.lit(False)).alias("hit")) for i, s, cond, v, c in rules])
    return d.select(F.inline(rows)).filter("hit").drop("hit")


def validate_summary(trials: DataFrame, declared_total: int, declared_ok: int, weights: dict[str, float],
                     direction: str = "maximize") -> DataFrame:
    """Problems of a summary against its trials: one row per broken rule."""
    d = one_row(trials.agg(_n().alias("n_all")), trial_patterns(trials)).withColumns({"_t": F.lit(declared_total), "_o": F.lit(declared_ok)})
    weight_sum = F.lit(float(sum(abs(w) for w in weights.values())))
    rules = [
        ("more_successes_than_trials", "error", F.col("_o") > F.col("_t"), F.col("_o"), 1),
        ("trial_count_differs", "error", F.col("n_all") != F.col("_t"), F.col("n_all"), 1),
        ("objective_weights_zero", "error", weight_sum == 0, weight_sum, 1),
        ("zero_candidates_rate", "warning", F.col("candidates_zero_rate") > 0.8, F.col("candidates_zero_rate"), 1),
        ("best_score_not_positive", "warning", (F.col("best_score") <= 0) & F.lit(direction == "maximize"), F.col("best_score"), 1),
    ]
    return _rule_rows(d, rules).drop("confidence")


# ---- threshold sweep -----------------------------------------------------------------------------

#: Candidates whose ranks one task follows through all trials.
BLOCK_ROWS = 65_536
#: Trials whose counts travel as one row.
TRIALS_PER_ROW = 512
_BLOCK_BITS = 6  # ranks of occurrence that are summed together


def _place(value: Column, table: Column, at_value: bool, steps: int = 24) -> Column:
    """Number of entries of the sorted array ``table`` below ``value`` (``at_value``: up to it), by halving steps."""
    fits = lambda x: x <= value if at_value else x < value
    powers = F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda at, step: F.when(fits(F.get(table, at + step - 1)), at + step).otherwise(at))


def sweep(cands: DataFrame, grid: DataFrame) -> DataFrame:
    """Number of candidates with ``dist_km >= D`` and ``occ_pct <= O`` for every trial.

    Offline dominance counting over ranks of the thresholds. A candidate counts in the cell (thresholds D reached, thresholds O too small); the
    candidates are read once, whatever the number of trials. A cell goes to the dyadic blocks of its D rank, one per level; a block keeps prefix counts
    over the O ranks (within runs of 64 ranks, and over runs). The D ranks of a trial are a union of at most one block per level,
    so it adds as many numbers as there are levels. No row per candidate and trial, no window longer than the thresholds over 64.
    """
    grid = grid.select("D", "O").distinct()
    found = grid.agg(*[F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in ("D", "O")]).first()  # two numbers a trial
    table = lambda c: F.split(F.lit(",".join(map(repr, found[c]))), ",").cast("array<double>")  # noqa: E731 folded to one literal
    top = max(1, len(found["D"]).bit_length())
    levels = F.sequence(F.lit(0), F.lit(top - 1))
    cells = cut(cands.select("dist_km", "occ_pct").dropna()
                .groupBy(_place(F.col("dist_km"), table("D"), True).alias("i"), _place(F.col("occ_pct"), table("O"), False).alias("j"))
                .agg(_n().alias("n")).filter("i > 0"))  # the one scan of the candidates
    held = cells.select(F.explode(levels).alias("level"), "i", "j", "n").select("level", F.expr("shiftright(i, level)").alias("block"), "j", "n")
    # the blocks of ranks from i up: always the largest one that begins there
    first = _place(F.col("D"), table("D"), True)
    ask = grid.dropna().withColumns({"i": first, "j": _place(F.col("O"), table("O"), False)})
    ask = ask.withColumn("level", F.explode(levels))
    at = F.expr("shiftright(i + shiftleft(1, level) - 1, level)")  # first block of the level at or above i
    ask = ask.withColumn("block", at).filter((F.col("block") % 2 == 1) & (F.expr("shiftleft(block, level)") < (1 << top)))
    rows = held.unionByName(ask.select("level", "block", "j", F.lit(0).cast("bigint").alias("n")))
    rows = rows.groupBy("level", "block", "j").agg(F.sum("n").alias("n")).withColumn("run", F.shiftright("j", _BLOCK_BITS))
    runs = rows.groupBy("level", "block", "run").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("level", "block").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("level", "block", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy("level", "block", "run").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    prefix = rows.withColumn("upto", F.sum("n").over(upto)).join(runs, ["level", "block", "run"])
    asked = ask.join(prefix.select("level", "block", "j", (F.col("before") + F.col("upto")).alias("n")), ["level", "block", "j"], "left")
    counts = asked.groupBy("D", "O").agg(F.sum("n").alias("n"))
    return grid.join(counts, ["D", "O"], "left").select("D", "O", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _harmonic(n: np.ndarray) -> np.ndarray:
    """1 + 1/2 + ... + 1/n; beyond 40 terms by the asymptotic series (error below 1e-14)."""
    short = np.append(0.0, np.cumsum(1.0 / np.arange(1, 41)))
    x = np.maximum(n, 1).astype(float)
    series = np.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)
    return np.where(n <= 40, short[np.clip(n, 0, 40)], series)


def _passing(pdf: pd.DataFrame, trials: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(trial, which candidates pass it), candidates in the order of their rank."""
    dist, occ = pdf["dist_km"].to_numpy(), pdf["occ_pct"].to_numpy()
    for t, (d, o) in enumerate(trials):
        yield t, (dist >= d) & (occ <= o)


def sweep_metrics(cands: DataFrame, known: DataFrame, grid: DataFrame, weights: dict[str, float], k: int = 100,
                  max_m: float = 500.0, tie: str = "cand_id", site: str = "site_id") -> DataFrame:
    """Count, recall@k, mAP and composite score for every (D, O) of ``grid``.

    Scores do not depend on the thresholds, so the candidates are ranked once and cut into blocks of ``BLOCK_ROWS`` consecutive ranks. A block
    counts what passes each trial; running totals over the blocks tell how many better candidates pass before it, and a second look
    gives the ranks of its candidates near a known site ("hits"). The mean precision over all ranks is a sum over hits, because a hit at
    rank r adds 1/r + ... + 1/n. Rows are blocks x trials in packs of ``TRIALS_PER_ROW``, and the first k candidates of a trial at most.
    The trials (two numbers each) travel with the job.
    """
    trials_df = grid.select("D", "O").distinct().orderBy("D", "O")
    trials = np.array([(r["D"], r["O"]) for r in trials_df.collect()], float).reshape(-1, 2)
    packs = [slice(lo, lo + TRIALS_PER_ROW) for lo in range(0, len(trials), TRIALS_PER_ROW)]
    scored = score_weighted(cands, weights).select(F.col(tie).cast("bigint").alias("_tie"), "total_score", "dist_km", "occ_pct", "lon", "lat").dropna(subset=["dist_km", "occ_pct"])
    flagged = cut(spatial.is_hit(scored, known, max_m))
    ranked = cut(ordered(flagged, "total_score", "_tie", desc=True).withColumn("_block", F.floor((F.col("rank") - 1) / BLOCK_ROWS)))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(trials), np.int64)
        for t, ok in _passing(pdf, trials):
            n[t] = np.count_nonzero(ok)
        return pd.DataFrame({"_block": key[0], "pack": range(len(packs)), "n": [n[p].tolist() for p in packs]})

    def totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        n = np.array(pdf["n"].tolist())
        upto = np.cumsum(n, 0)
        return pd.DataFrame({"_block": pdf["_block"], "pack": key[0], "before": list(upto - n), "total": [upto[-1]] * len(pdf)})

    packed = "_block BIGINT, pack INT, n ARRAY<BIGINT>"
    counts = ranked.select("_block", "dist_km", "occ_pct").groupBy("_block").applyInPandas(count, packed)
    before = cut(counts.groupBy("pack").applyInPandas(totals, "_block BIGINT, pack INT, before ARRAY<BIGINT>, total ARRAY<BIGINT>"))

    def follow(pdf: pd.DataFrame, packs_: pd.DataFrame) -> pd.DataFrame:
        packs_ = packs_.sort_values("pack")
        start, total = (np.concatenate(packs_[c].tolist()) for c in ("before", "total"))
        pdf = pdf.sort_values("rank")
        hit, ids, out = pdf["is_hit"].to_numpy(bool), pdf["_tie"].to_numpy(), []
        for t, ok in _passing(pdf, trials):
            at = np.flatnonzero(ok & hit)
            if len(at):
                r = start[t] + np.cumsum(ok)[at]
                ap = float((_harmonic(total[t : t + 1]) - _harmonic(r - 1)).sum()) / total[t]
                out.append((t, ap, ids[at[r <= k]]))
        return pd.DataFrame(out, columns=["t", "ap", "first"])

    order = ranked.select("_block", "rank", "_tie", "is_hit", "dist_km", "occ_pct")
    parts = cut(order.groupBy("_block").cogroup(before.groupBy("_block")).applyInPandas(follow, "t INT, ap DOUBLE, first ARRAY<BIGINT>"))
    near = spatial.near_pairs(
        spatial.with_planar(ranked.filter("is_hit").select("_tie", "lon", "lat"), "utm21s").select("_tie", "x", "y"),
        spatial.with_planar(known, "utm21s", x="x2", y="y2").select(F.col(site).alias("site"), "x2", "y2"), max_m)
    matched = (parts.select("t", F.explode("first").alias("_tie")).join(near.select("_tie", "site", "dist"), "_tie")
               .groupBy("t", "site", "dist").agg(_n().alias("n"))
               .groupBy("t", "site").agg(F.min_by("n", "dist").alias("n"))
               .groupBy("t").agg(F.sum("n").alias("matched")))
    sizes = before.groupBy("pack").agg(F.any_value("total").alias("total")).select("pack", F.posexplode("total").alias("p", "total"))
    sizes = sizes.select((F.col("pack") * TRIALS_PER_ROW + F.col("p")).alias("t"), "total")
    spark = cands.sparkSession
    out = spark.createDataFrame([(t, float(d), float(o)) for t, (d, o) in enumerate(trials)], "t INT, D DOUBLE, O DOUBLE")
    for part in (sizes, parts.groupBy("t").agg(F.sum("ap").alias("map")), matched):
        out = out.join(part, "t", "left")
    out = out.withColumn("_k", known.agg(_n()).scalar()).select(
        "D", "O", F.coalesce("total", F.lit(0)).cast("bigint").alias("n_candidates"),
        F.coalesce(F.try_divide(F.col("matched"), F.col("_k")), F.lit(0.0)).alias("recall"), F.coalesce("map", F.lit(0.0)).alias("map"))
    return out.withColumn("composite_score", metrics.composite(F.col("recall"), F.col("map"), F.col("n_candidates")))


def best_sweep(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("composite_score"), "D", "O").limit(1)
