"""Scaling, correlation, and similarity of candidates to known sites."""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from toposcan.operators import aggregates, leaveout, vectors
from toposcan.operators.dictionary import examples
from toposcan.operators.ordered import ordered, quantiles, rank_by
from toposcan.operators.textmine import cluster_first_word
from toposcan.session import cut


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """Centre and width per column (nulls count as 0); a width of zero becomes 1. The model has one entry per column."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    if kind == "robust":
        long = df.select(*[value(c).alias(c) for c in cols]).unpivot([], list(cols), "name", "v")
        rows = quantiles(long, "v", {"a": 0.25, "m": 0.5, "b": 0.75}, ["name"]).collect()
        model = {r["name"]: (r["m"], r["b"] - r["a"]) for r in rows}
    elif kind == "minmax":
        r = df.agg(*[F.min(value(c)).alias(f"a_{c}") for c in cols], *[F.max(value(c)).alias(f"b_{c}") for c in cols]).first()
        model = {c: (r[f"a_{c}"], r[f"b_{c}"] - r[f"a_{c}"]) for c in cols}
    else:
        r = df.agg(*[F.avg(value(c)).alias(f"a_{c}") for c in cols], *[F.stddev_pop(value(c)).alias(f"b_{c}") for c in cols]).first()
        model = {c: (r[f"a_{c}"], r[f"b_{c}"]) for c in cols}
    # a deviation that is only rounding noise of a constant column is no width
    return {c: (m, w if w is not None and w > 1e-12 * max(1.0, abs(m or 0.0)) else 1.0) for c, (m, w) in model.items()}


def apply_scaler(df: DataFrame, model: dict[str, tuple[float, float]]) -> DataFrame:
    """Scale the model's columns of any table with those columns."""
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / w for c, (m, w) in model.items()})


def scale(df: DataFrame, cols: Sequence[str], kind: str = "standard") -> DataFrame:
    """``df`` with its columns scaled. Read twice, so what leads to it is done once before."""
    df = cut(df)
    return apply_scaler(df, fit_scaler(df, cols, kind))


def transform_like(df: DataFrame, model: dict[str, tuple[float, float]], kept: Sequence[str], key: str = "site_name") -> DataFrame:
    return apply_scaler(df, model).select(key, *kept)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    vec = df.select(array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])).alias("v"))
    return Correlation.corr(vec, "v").first()[0].toArray()


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """``a, b, r`` for column pairs with \\|r\\| above the threshold; the matrix is columns by columns."""
    m = correlation_matrix(df, cols)
    rows = [(cols[i], cols[j], float(m[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols)) if abs(m[i, j]) > threshold]
    return df.sparkSession.createDataFrame(rows, "a STRING, b STRING, r DOUBLE")


def kept_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns whose correlation with every earlier column stays within the threshold."""
    m = np.abs(correlation_matrix(df, cols))
    return [c for j, c in enumerate(cols) if not any(m[i, j] > threshold for i in range(j))]


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """``df`` without the columns of ``cols`` that repeat an earlier one. Read twice, so what leads to it is done once before."""
    df = cut(df)
    kept = kept_columns(df, cols, threshold)
    return df.drop(*[c for c in cols if c not in kept])


def to_vectors(df: DataFrame, cols: Sequence[str], key: str = "site_name") -> DataFrame:
    """``id, name, v``; the id is a hash of the name."""
    return df.select(F.xxhash64(key).alias("id"), F.col(key).alias("name"),
                     F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("v"))


def _dist(center: np.ndarray):
    """Euclidean distance of column ``v`` to a fixed point."""
    point = F.array(*[F.lit(float(x)) for x in center])
    return F.sqrt(F.aggregate(F.zip_with("v", point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def cluster_score(test: DataFrame, train: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``id, cluster_score`` = exp(-distance to the nearest of k k-means centres of the known sites)."""
    model = KMeans(k=k, seed=seed, featuresCol="f", maxIter=50).fit(train.select(array_to_vector("v").alias("f")))
    return center_score(test, model.clusterCenters())


def center_score(test: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """``id, cluster_score`` = exp(-distance to the nearest of the given centres)."""
    nearest = F.array_min(F.array(*[_dist(c) for c in centers]))
    return test.select("id", F.exp(-nearest).alias("cluster_score"))


def _log_density(x: np.ndarray, weights, means, covs) -> np.ndarray:
    """Log density of a Gaussian mixture, with 1e-6 on the diagonals."""
    d, parts = x.shape[1], []
    for w, m, c in zip(weights, means, covs):
        low = np.linalg.cholesky(c + 1e-6 * np.eye(d))
        z = np.linalg.solve(low, (x - m).T)
        parts.append(math.log(max(w, 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + (z**2).sum(0)) - np.log(np.diag(low)).sum())
    top = np.max(parts, axis=0)
    return top + np.log(np.exp(np.array(parts) - top).sum(axis=0))


def gmm_score(test: DataFrame, train: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``id, log_likelihood, gaussian_score``; scores of many features underflow to 0, so the logarithm is kept."""
    model = GaussianMixture(k=k, seed=seed, featuresCol="f").fit(train.select(array_to_vector("v").alias("f")))
    rows = model.gaussiansDF.collect()  # k rows
    weights, means, covs = model.weights, [r["mean"].toArray() for r in rows], [r["cov"].toArray() for r in rows]

    @F.pandas_udf(T.DoubleType())
    def density(v: pd.Series) -> pd.Series:
        return pd.Series(_log_density(np.array(v.tolist(), dtype=float), weights, means, covs)) if len(v) else pd.Series([], dtype=float)

    d = test.select("id", density("v").alias("log_likelihood"))
    return d.withColumn("gaussian_score", F.exp("log_likelihood"))


def isolation_score(test: DataFrame, train: DataFrame, trees: int = 100, contamination: float = 0.2, seed: int = 42,
                    tree_rows: int = 256) -> DataFrame:
    """``id, anomaly_score`` = (decision + 1) / 2 of an isolation forest fitted on the known sites.

    Every tree is grown in a task of its own from a hash sample of at most ``tree_rows`` rows (the algorithm's own
    subsample), whatever the size of the table; the trees (bounded by that) travel with the scoring job.
    """
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(["h", "id"]).head(tree_rows)["v"].tolist(), dtype=float)
        tree = leaveout.grow(x, leaveout.max_depth(len(x)), seed, int(pdf["tree"].iat[0]))
        return pd.DataFrame({"size": [len(x)], "tree": [pickle.dumps(tree)]})

    sample = leaveout.tree_samples(train, train.count(), trees, seed, tree_rows)
    grown = sample.groupBy("tree").applyInPandas(grow, "size INT, tree BINARY").collect()  # ``trees`` rows of at most ``tree_rows`` leaves
    forest, size = [pickle.loads(r["tree"]) for r in grown], max(r["size"] for r in grown)

    @F.pandas_udf(T.DoubleType())
    def normality(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.array(v.tolist(), dtype=float)
        return pd.Series(leaveout.normality(np.mean([leaveout.depths(t, x) for t in forest], axis=0), size))

    offset = quantiles(cut(train.select(normality("v").alias("s"))), "s", {"q": contamination}).first()[0]
    return test.select("id", ((normality("v") - F.lit(offset) + 1.0) / 2.0).alias("anomaly_score"))


def composite_similarity(df: DataFrame) -> DataFrame:
    return df.withColumn("composite_score", 0.35 * F.col("knn_score") + 0.25 * F.col("cluster_score")
                         + 0.25 * F.col("gaussian_score") + 0.15 * F.col("anomaly_score"))


def similarity_scores(test: DataFrame, train: DataFrame, seed: int = 42) -> DataFrame:
    """All scores of candidate vectors against known vectors (``id, name, v`` both)."""
    d = test.select("id", "name").join(vectors.knn_score(test.select("id", "v"), train.select("id", "v")), "id")
    for part in (cluster_score(test, train, seed=seed), gmm_score(test, train, seed=seed), isolation_score(test, train, seed=seed)):
        d = d.join(part, "id")
    return composite_similarity(d)


def loo_scores(train: DataFrame, k: int = 3, seed: int = 42, trees: int = 100, contamination: float = 0.2) -> DataFrame:
    """Scores of every known site (``id, name, v``) by models of all the others.

    No model is refitted per site: each is fitted once and the site's share taken out of it, see :mod:`toposcan.operators.leaveout`. A single site has
    null scores; of fewer than four the mixture score is that of the neighbours.
    """
    rows = cut(train.select("id", "name", "v"))
    n = rows.count()
    none = rows.select("id", F.lit(None).cast("double").alias("s"))
    pairs = rows.select("id", "v")
    parts = [
        leaveout.cluster_scores(pairs, min(k, n - 1), seed) if n > 2 else vectors.knn_score(pairs, pairs, leave_one_out=True).withColumnRenamed("knn_score", "cluster_score"),
        leaveout.mixture_scores(pairs, min(k, n - 1), seed) if n > 3 else none.withColumnRenamed("s", "log_likelihood"),
        leaveout.forest_scores(pairs, trees, contamination, seed) if n > 1 else none.withColumnRenamed("s", "anomaly_score"),
        vectors.knn_score(pairs, pairs, leave_one_out=True),
    ]
    d = rows.select("id", "name")
    for part in parts:
        d = d.join(part, "id", "left")
    return composite_similarity(d.withColumn("gaussian_score", F.coalesce(F.exp("log_likelihood"), "knn_score")))


def pca2(vec: DataFrame) -> tuple[DataFrame, list[float]]:
    """``id, pc1, pc2`` of centred vectors and the explained variance of both axes."""
    dim = vec.select(F.size("v")).first()[0]
    means = vec.agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()
    centre = F.array(*[F.lit(float(means[i])) for i in range(dim)])
    d = vec.select("id", array_to_vector(F.zip_with("v", centre, lambda a, b: a - b)).alias("f"))
    model = PCA(k=2, inputCol="f", outputCol="p").fit(d)
    out = model.transform(d).select("id", vector_to_array("p").alias("p"))
    return out.select("id", F.get("p", F.lit(0)).alias("pc1"), F.get("p", F.lit(1)).alias("pc2")), list(model.explainedVariance.toArray())


def _dense(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their labels numbered 0, 1, ... in the order of the labels, and the number of labels."""
    names = cut(ordered(rows.select(F.col("label").cast("long").alias("label")).distinct(), "label", "label", rank="_n"))
    dense = rows.withColumn("label", F.col("label").cast("long")).join(names, "label").drop("label")
    return dense.withColumn("label", (F.col("_n") - 1).cast("int")).drop("_n"), names.count()


def silhouette(rows: DataFrame) -> DataFrame:
    """Mean silhouette (Euclidean) of ``id, label, v``; labels are any integers, clusters of one row count 0."""
    rows, n_labels = _dense(rows.select("id", "label", "v"))
    return silhouettes(rows.select("id", F.array("label").alias("labels"), "v"), [n_labels]).select("silhouette")


def silhouettes(rows: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``labelling, silhouette`` for several labellings of the same rows: the distances are measured once for all.

    ``rows`` is ``id, labels, v`` with a label per labelling; labelling ``i`` numbers its labels 0 to ``sizes[i] - 1``.
    """
    first = [sum(sizes[:i]) for i in range(len(sizes))]
    numbered = F.zip_with("labels", F.array(*[F.lit(x) for x in first]), lambda x, y: (x + y).cast("int"))
    rows = cut(rows.select("id", numbered.alias("labels"), "v"))
    owner = F.array(*[F.lit(i) for i, n in enumerate(sizes) for _ in range(n)])
    counts = rows.select(F.explode("labels").alias("other")).groupBy("other").agg(F.count(F.lit(1)).alias("size"))
    sums = vectors.block_sums(rows, sum(sizes)).join(counts, "other").join(rows.select("id", "labels"), "id")
    own = F.array_contains("labels", F.col("other"))
    per = sums.groupBy("id", F.get(owner, F.col("other")).alias("labelling")).agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"), F.max(F.when(own, F.col("size"))).alias("n"))
    s = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.groupBy("labelling").agg(F.avg(s).alias("silhouette"))


def _square(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _scatter(rows: DataFrame) -> DataFrame:
    """Per label: ``n`` rows, centre ``c``, within sum of squares ``w``, mean distance ``s`` to the centre."""
    vec = rows.select("label", "v", array_to_vector("v").alias("f"))
    centers = vec.groupBy("label").agg(Summarizer.mean(F.col("f")).alias("c"), F.count(F.lit(1)).alias("n"))
    centers = cut(centers.select("label", "n", vector_to_array("c").alias("c")))
    d = vec.select("label", "v").join(centers.select("label", "c"), "label").withColumn("d2", _square("v", "c"))
    stats = d.groupBy("label").agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"))
    return cut(centers.join(stats, "label"))


def cluster_quality(rows: DataFrame) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin of ``id, label, v``: one row.

    Davies-Bouldin compares every two centres, by its definition.
    """
    per = _scatter(rows)
    total = rows.select(array_to_vector("v").alias("f")).agg(Summarizer.mean(F.col("f")).alias("m")).select(vector_to_array("m").alias("m")).first()["m"]
    mean = F.array(*[F.lit(float(x)) for x in total])
    r = per.withColumn("m", mean).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("within"), F.sum(F.col("n") * _square("c", "m")).alias("between")).first()
    ch = r["between"] / (r["k"] - 1) / (r["within"] / (r["n"] - r["k"])) if r["within"] else 1.0
    other = per.select(F.col("label").alias("label2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    pairs = per.select("label", "c", "s").join(other, F.col("label") != F.col("label2"))
    db = pairs.groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / F.sqrt(_square("c", "c2"))).alias("r")).agg(F.avg("r")).first()[0]
    return silhouette(rows).withColumns({"calinski_harabasz": F.lit(float(ch)), "davies_bouldin": F.lit(db).cast("double")})


def cluster_vectors(vec: DataFrame, k: int | None = None, k_range: tuple[int, int] = (2, 10), seed: int = 42) -> tuple[DataFrame, int]:
    """k-means labels ``id, label, v``; without ``k`` the number with the best silhouette is taken."""
    d = cut(vec.select("id", "v", array_to_vector("v").alias("f")))
    fit = lambda n, out: KMeans(k=n, seed=seed, featuresCol="f", predictionCol=out).fit(d)
    if k is not None:
        return fit(k, "label").transform(d).select("id", "label", "v"), k
    tried = list(range(k_range[0], min(k_range[1], d.count() - 1) + 1))
    labelled = d
    for n in tried:
        labelled = fit(n, f"l{n}").transform(labelled)
    labelled = cut(labelled.select("id", "v", *[f"l{n}" for n in tried]))
    found = silhouettes(labelled.select("id", F.array(*[f"l{n}" for n in tried]).alias("labels"), "v"), tried).collect()  # a row per k
    k = tried[min(found, key=lambda r: (-r["silhouette"], r["labelling"]))["labelling"]]
    return labelled.select("id", F.col(f"l{k}").alias("label"), "v"), k


def cluster_types(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``cluster, n, mean_score, cluster_type`` from ``cluster, water_score``."""
    d = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("water_score").alias("mean_score"))
    return d.withColumn("cluster_type", F.when(F.col("mean_score") >= threshold, "water").otherwise("non-water"))


def cluster_summary(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Type, size, first examples and most frequent first word per cluster (``cluster, name, ord, water_score``)."""
    words = cluster_first_word(df).select("cluster", "first_word")
    return cluster_types(df, threshold).join(examples(df, "cluster"), "cluster").join(words, "cluster", "left")


def rank_candidates(known_rows: DataFrame, cand_rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rank candidate sites by similarity to known sites, both given as site-toponym rows.

    Features, scaler and kept columns come from the known sites. ``above_known`` is the share of candidates that
    score above the mean of the known sites, each scored by models without itself (``loo_scores``).
    """
    known, cand = cut(aggregates.engineer_features(known_rows)), aggregates.engineer_features(cand_rows)
    cols = [c for c in known.columns if c != "site_name"]
    model = fit_scaler(known, cols)
    scaled = apply_scaler(known, model)
    kept = kept_columns(scaled, cols)
    train = cut(to_vectors(scaled, kept))
    test = cut(to_vectors(transform_like(cand, model, kept), kept))
    scores = cut(similarity_scores(test, train, seed))
    known_mean = loo_scores(train, seed=seed).agg(F.avg("composite_score")).first()[0]
    share = scores.agg(F.avg((F.col("composite_score") > known_mean).cast("double"))).scalar()
    ranked = rank_by(scores, "composite_score", "id").withColumn("above_known", share)
    return ranked.withColumnRenamed("name", "site_name").drop("id")
