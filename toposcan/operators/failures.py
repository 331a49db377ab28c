"""Failure analysis of candidates and scoring of improvement proposals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.functions import text
from toposcan.operators.ordered import ordered, quantiles

COMMON = ["type", "pattern", "count", "severity"]


def _n() -> Column:
    return F.count(F.lit(1))


def _word_counts(df: DataFrame) -> DataFrame:
    word = text.first_word(F.col("name"))
    return df.select(word.alias("pattern")).filter(F.col("pattern") != "").groupBy("pattern").agg(_n().alias("count"))


def overrepresented(df: DataFrame) -> DataFrame:
    """First words of at least max(3, 10 % of rows) names."""
    d = _word_counts(df).withColumn("_t", df.agg(_n()).scalar())
    d = d.filter(F.col("count") >= F.greatest(F.lit(3.0), F.col("_t") * 0.1))
    return d.select(F.lit("root_overrepresentation").alias("type"), "pattern", "count",
                    F.when(F.col("count") < 10, "medium").otherwise("high").alias("severity"))


def fragmentation(df: DataFrame) -> DataFrame:
    """One row when first words that occur once make up more than 30 % of the rows."""
    d = _word_counts(df).agg(F.count_if(F.col("count") == 1).alias("count")).withColumn("_t", df.agg(_n()).scalar())
    return d.filter(F.col("count") > F.col("_t") * 0.3).select(
        F.lit("root_fragmentation").alias("type"), F.lit("unique_patterns").alias("pattern"), "count", F.lit("medium").alias("severity"))


def dense_cells(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """0.1 degree cells with at least five candidates, when there are enough candidates to judge."""
    ok = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    cells = ok.groupBy(F.bround(lon, 1).alias("clon"), F.bround(lat, 1).alias("clat")).agg(_n().alias("count"))
    d = cells.withColumns({"_all": df.agg(_n()).scalar(), "_ok": ok.agg(_n()).scalar()})
    d = d.filter((F.col("_all") > 100) & (F.col("_ok") > 10) & (F.col("count") >= 5))
    return d.select(F.lit("spatial_clustering").alias("type"), F.format_string("%.1f, %.1f", "clat", "clon").alias("pattern"), "count",
                    F.when(F.col("count") < 10, "medium").otherwise("high").alias("severity"))


def far_candidates(df: DataFrame) -> DataFrame:
    """One row for the candidates beyond the 90th percentile of distance, when that exceeds 5 km."""
    cut = quantiles(df, "dist_km", {"q": 0.9}).scalar()
    d = df.withColumn("_q", cut).filter((F.col("_q") > 5.0) & (F.col("dist_km") > F.col("_q")))
    return d.groupBy("_q").agg(_n().alias("count")).select(
        F.lit("excessive_distance").alias("type"), F.lit("far_from_rivers").alias("pattern"), "count",
        F.when(F.col("_q") < 10, "medium").otherwise("high").alias("severity"))


def find_failures(df: DataFrame) -> DataFrame:
    parts = [dense_cells(df), overrepresented(df), fragmentation(df), far_candidates(df)]
    return reduce(DataFrame.unionByName, [p.select(*COMMON) for p in parts])


def failure_groups(failures: DataFrame) -> DataFrame:
    """Failures per type: number, total count, highest severity."""
    code = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    d = failures.groupBy("type").agg(_n().alias("n_failures"), F.sum("count").alias("total_count"), F.max(code).alias("_c"))
    return d.select("type", "n_failures", "total_count",
                    F.when(F.col("_c") == 3, "high").when(F.col("_c") == 2, "medium").otherwise("low").alias("severity"))


# Actions that count as rare.
RARE_ACTIONS = ["modify_prompt", "add_eval_set", "add_exclude_mask"]


def jaccard_diversity(props: DataFrame, key: str = "prop_id", actions: str = "actions") -> DataFrame:
    """Add ``diversity_score``: 1 - mean Jaccard similarity of the action sets with all other proposals, +0.2 for rare actions.

    Proposals with the same set of actions are one row with a count, and only sets that share an
    action are joined: disjoint sets have similarity 0.
    """
    d = props.withColumn("_set", F.array_sort(F.array_distinct(actions)))
    sets = d.groupBy("_set").agg(_n().alias("m"))
    one = sets.select("_set", F.explode("_set").alias("a"))
    other = sets.select(F.col("_set").alias("_other"), "m", F.explode("_set").alias("a"))
    shared = one.join(other, "a").groupBy("_set", "_other", "m").agg(_n().alias("common"))
    jac = F.col("common") / (F.size("_set") + F.size("_other") - F.col("common"))
    total = shared.groupBy("_set").agg(F.sum(jac * F.col("m")).alias("_sum"))
    counts = sets.agg(F.struct(F.sum("m").alias("n"), F.sum(F.when(F.size("_set") == 0, F.col("m")).otherwise(0)).alias("empty")).alias("c"))
    per_set = sets.join(total, "_set", "left").withColumn("_c", counts.scalar())
    empty = F.size("_set") == 0
    # an empty set against another empty set has no union and is left out of the mean
    others = F.when(empty, F.col("_c.n") - F.col("_c.empty")).otherwise(F.col("_c.n") - 1)
    same = F.when(empty, 0.0).otherwise(1.0)
    mean = F.coalesce(F.try_divide(F.coalesce("_sum", F.lit(0.0)) - same, others), F.lit(0.0))
    rare = F.when(F.arrays_overlap("_set", F.array(*[F.lit(a) for a in RARE_ACTIONS])), 0.2).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean + rare))
    per_set = per_set.select("_set", F.when(F.col("_c.n") <= 1, 1.0).otherwise(score).alias("diversity_score"))
    return d.join(per_set, "_set").drop("_set")


def _has(col: Column, words: Sequence[str]) -> Column:
    return text.contains_any(F.lower(F.coalesce(col, F.lit(""))), words)


# Bonus per priority.
PRIORITY_BONUS = {"high": 0.2, "medium": 0.1}


def proposal_scores(props: DataFrame, key: str = "prop_id", clusters: Sequence[str] = ()) -> DataFrame:
    """Add ``improvement_score`` and ``cost_score`` from ``effects`` (metric to text), ``priority``, ``effort``, ``risk``.

    ``clusters`` names known failure groups; a proposal whose title or ``rationale`` (where there is one) speaks of one gains
    0.1 each. ``effects`` is a map, so an entry that names cost or api is the only one of its name; the largest penalty counts.
    """
    told = F.concat_ws(" ", *[c for c in ("title", "rationale") if c in props.columns])
    x = text.numeric_change(F.col("effect"))
    m = F.col("metric")
    gain = (
        F.when(m.isin("recall@100", "map"), F.when(x > 0, F.least(F.lit(0.4), x / 20.0)).otherwise(0.0))
        .when(m == "workload", F.when(x < 0, F.least(F.lit(0.2), -x / 500.0)).when(x > 0, -F.least(F.lit(0.1), x / 1000.0)).otherwise(0.0))
        .when(m.isin("root_diversity", "precision"), F.when(x > 0, F.least(F.lit(0.2), x / 10.0)).otherwise(0.0))
        .otherwise(0.0))
    api = F.when(_has(m, ["cost", "api"]) & F.col("effect").contains("+") & (x > 0), F.least(F.lit(0.2), x / 50.0)).otherwise(0.0)
    long = props.select(key, F.explode("effects").alias("metric", "effect"))
    sums = long.groupBy(key).agg(F.sum(gain).alias("_gain"), F.max(api).alias("_api"))
    d = props.join(sums, key, "left")
    bonus = F.lit(0.0)
    for level, value in PRIORITY_BONUS.items():
        bonus = F.when(F.col("priority") == level, value).otherwise(bonus)
    for c in clusters:
        bonus = bonus + F.when(_has(told, [c.lower(), "distance", "root", "spatial"]), 0.1).otherwise(0.0)
    effort = (
        F.when(F.col("effort").contains("★★★"), 0.2).when(F.col("effort").contains("★★☆"), 0.6).when(F.col("effort").contains("★☆☆"), 1.0)
        .when(_has(F.col("effort"), ["day", "week"]), 0.1).when(_has(F.col("effort"), ["hour", "h"]), 0.7)
        .when(_has(F.col("effort"), ["min"]), 1.0).otherwise(0.5))
    risk = (
        F.when(_has(F.col("risk"), ["high", "major", "significant"]), 0.3).when(_has(F.col("risk"), ["medium", "moderate"]), 0.1)
        .when(_has(F.col("risk"), ["low", "minor", "minimal"]), 0.0).when(_has(F.col("risk"), ["cost", "expensive", "api"]), 0.2)
        .when(_has(F.col("risk"), ["complexity", "difficult", "hard"]), 0.15).otherwise(0.0))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return d.withColumns({
        "improvement_score": clip(F.coalesce("_gain", F.lit(0.0)) + bonus),
        "cost_score": clip(effort - risk - F.coalesce("_api", F.lit(0.0)))}).drop("_gain", "_api")


def rank_proposals(props: DataFrame, key: str = "prop_id", weights: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """Add ``total_score`` and ``rank`` from the improvement, diversity and cost scores."""
    a, b, c = weights
    d = props.withColumn("total_score", a * F.col("improvement_score") + b * F.col("diversity_score") + c * F.col("cost_score"))
    return ordered(d, "total_score", key, desc=True)
