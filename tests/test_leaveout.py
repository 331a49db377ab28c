"""Leave-one-out scores against literal refits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcan.operators import leaveout as L, similarity


def blobs(seed, n, d=2, k=3, spread=1.0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (n, d)) + rng.normal(0, 3, (k, d))[rng.integers(0, k, n)]


def frame(spark, x):
    return spark.createDataFrame([(i, f"s{i}", [float(c) for c in row]) for i, row in enumerate(x)], "id BIGINT, name STRING, v ARRAY<DOUBLE>")


def lloyd(x, centers):
    for _ in range(200):
        label = ((x[:, None] - centers[None]) ** 2).sum(2)
        label = np.where(np.isnan(label), np.inf, label).argmin(1)
        new = np.array([x[label == c].mean(0) if (label == c).any() else np.full(x.shape[1], np.nan) for c in range(len(centers))])
        if np.allclose(new, centers, rtol=0, atol=1e-13, equal_nan=True):
            break
        centers = new
    return centers


@pytest.mark.parametrize("boundary", [5_000, 40])
def test_cluster_scores_equal_a_literal_refit(spark, boundary, monkeypatch):
    x = np.vstack([blobs(1, 193, spread=2.0), [[40.0, 40.0]], [[7.0, 7.0]] * 6])  # overlapping blobs, a cluster of one row, equal rows
    df = frame(spark, x)
    passes = []
    plain = L.refit
    monkeypatch.setattr(L, "refit", lambda rows, out, c: passes.append(len(out)) or plain(rows, out, c))
    got = {r.id: r.cluster_score for r in L.cluster_scores(df, 4, boundary_rows=boundary).collect()}
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=4, seed=42, featuresCol="f", maxIter=100, tol=0.0).fit(df.select(array_to_vector("v").alias("f")))
    start = lloyd(x, np.array(model.clusterCenters()))
    moved = 0
    for i in range(len(x)):
        c = lloyd(np.delete(x, i, 0), start)
        moved += not np.allclose(np.sort(c, 0)[:3], np.sort(start, 0)[:3], atol=1e-3)
        assert got[i] == pytest.approx(math.exp(-np.nanmin(np.sqrt(((c - x[i]) ** 2).sum(1)))), rel=1e-9), i
    assert sum(passes) < (60 if boundary == 40 else 2)


def test_mixture_scores_equal_a_literal_em_step(spark):
    x = blobs(2, 200, d=3)
    df = frame(spark, x)
    got = {r.id: r.log_likelihood for r in L.mixture_scores(df, 3).collect()}
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    m = GaussianMixture(k=3, seed=42, featuresCol="f").fit(df.select(array_to_vector("v").alias("f")))
    rows = m.gaussiansDF.collect()
    w, means, covs = np.array(m.weights), np.array([r["mean"].toArray() for r in rows]), np.array([r["cov"].toArray() for r in rows]) + L.RIDGE * np.eye(3)

    def em(y, w, means, covs, steps):
        for _ in range(steps):
            logs = L._parts(y, w, means, covs)[0]
            r = np.exp(logs - L._log_sum(logs)[:, None])
            n = r.sum(0)
            means = (r.T @ y) / n[:, None]
            covs = np.array([((y - c) * r[:, i : i + 1]).T @ (y - c) / n[i] for i, c in enumerate(means)]) + L.RIDGE * np.eye(y.shape[1])
            w = n / len(y)
        return w, means, covs

    def density(point, model):
        return float(L._log_sum(L._parts(point[None], *model)[0])[0])

    gap = []
    for i in range(len(x)):
        rest = np.delete(x, i, 0)
        assert got[i] == pytest.approx(density(x[i], em(rest, w, means, covs, 1)), abs=1e-5)
        if i % 10 == 0:
            gap.append(abs(got[i] - density(x[i], em(rest, w, means, covs, 60))))
    assert np.median(gap) < 0.05  # a refit to convergence from the same start


def test_wide_tables_stay_finite(spark):
    x = np.random.default_rng(3).normal(size=(12, 30))  # more columns than rows
    got = L.mixture_scores(frame(spark, x), 3).collect()
    assert len(got) == 12 and all(r.log_likelihood is not None and not math.isnan(r.log_likelihood) for r in got)


@pytest.mark.parametrize("n", [60, 400])
def test_forest_scores_equal_trees_grown_without_the_row(spark, n):
    x, trees, size = blobs(4, n), 12, 64
    got = {r.id: r.anomaly_score for r in L.forest_scores(frame(spark, x), trees, 0.2, 7, size).collect()}
    sample = L.tree_samples(frame(spark, x), n, trees, 7, size + 1).select("tree", "id", "h").toPandas().sort_values(["tree", "h", "id"])
    picks = {t: g["id"].tolist() for t, g in sample.groupby("tree")}

    def forest(left_out):
        out = []
        for t in range(trees):
            own = [i for i in picks[t] if i != left_out][:size]
            out.append(L.grow(x[own], L.max_depth(len(own)), 7, t))
        return out, len(own)

    full, full_size = forest(None)
    scores = L.normality(np.mean([L.depths(t, x) for t in full], axis=0), full_size)
    gap = []
    for i in range(0, n, 7):
        own, own_size = forest(i)
        mine = L.normality(np.mean([L.depths(t, x[[i]]) for t in own], axis=0), own_size)[0]
        others = np.delete(scores, i)
        assert got[i] == pytest.approx((mine - np.quantile(others, 0.2) + 1) / 2, abs=1e-9)
        rescored = np.delete(L.normality(np.mean([L.depths(t, x) for t in own], axis=0), own_size), i)
        gap.append(abs(got[i] - (mine - np.quantile(rescored, 0.2) + 1) / 2))
    assert max(gap) < 0.02  # the offset of a forest that scores the others anew


def test_loo_scores_of_few_and_of_many(spark):
    for n in (0, 1, 2, 3, 5):
        rows = similarity.loo_scores(frame(spark, blobs(5, max(n, 1))).filter(F.col("id") < n), trees=5).collect()
        assert len(rows) == n
        assert all((r.composite_score is None) == (n == 1) for r in rows), n


def test_fifty_thousand_rows_are_scored(spark):
    df = spark.range(50_000).select("id", F.array(F.sin(F.col("id") * 1.7) + F.col("id") % 3 * 4, F.cos(F.col("id") * 2.3)).alias("v")).repartition(8)
    clusters, mixture, forest = L.cluster_scores(df, 3), L.mixture_scores(df, 3), L.forest_scores(df, 10)
    for part, c in ((clusters, "cluster_score"), (mixture, "log_likelihood"), (forest, "anomaly_score")):
        r = part.agg(F.count(c).alias("n"), F.countDistinct("id").alias("ids"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        assert r.n == r.ids == 50_000 and r.lo < r.hi < 1.5
