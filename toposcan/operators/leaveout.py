"""Leave-one-out scores without a refit per row.

Every model is fitted once on all rows; what one row has put into it is then taken out again.

- k-means (``cluster_scores``). The literal refit is Lloyd's iteration on the other rows, started from the centres of all. Removing a row moves
  one centre by its distance over (rows of the cluster - 1). A row changes its cluster only when centres move by half its margin, the
  distance to the second nearest centre less that to its own. The ``BOUNDARY_ROWS`` rows of the smallest margins travel with the job, sorted; each
  left-out row iterates over those of them within reach of the movement, mostly none. Where the movement could reach a row that is not
  among them, the row is refitted literally, many rows to a pass. The result equals the literal refit up to rounding.
- Gaussian mixture (``mixture_scores``). The literal refit is one EM iteration on the other rows, started from the model of all: its counts, sums and
  scatter less the row's share. The density of the row itself then follows from its Mahalanobis distance by a rank-one formula, with no matrix per row.
- Isolation forest (``forest_scores``). A tree whose sample does not hold the row stays as it is. In the others the row's way down the
  tree that the remaining sample would grow is followed alone; choices are drawn by seed, tree and node, so it is the tree that a refit grows. The
  offset is the quantile of the other rows' scores under the forest of all.

``id`` must be unique. A removed row that was alone in its cluster leaves no centre behind.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from toposcan.operators.ordered import quantiles
from toposcan.session import cut

BOUNDARY_ROWS = 5_000
REFITS_PER_PASS = 256
MAX_STEPS = 100
RIDGE = 1e-6


def _rows(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=float)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Rows x centres; a centre of nan is nobody's."""
    d = np.sqrt(((x[:, None, :] - centers[None, :, :]) ** 2).sum(2))
    return np.where(np.isnan(d), np.inf, d)


# ---- k-means

def _step(rows: DataFrame, left_out: list, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the clusters of every state: state s has the centres ``centers[s]`` and leaves out the id ``left_out[s]`` (None: no row).

    One pass over the rows for all states; a partition yields a row per state and cluster.
    """
    states, k, d = centers.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros((states, k)), np.zeros((states, k, d))
        for b in batches:
            if len(b):
                ids, x = b["id"].to_numpy(), _rows(b["v"])
                for i in range(states):
                    keep = slice(None) if left_out[i] is None else ids != left_out[i]
                    own = x[keep]
                    label = _distances(own, centers[i]).argmin(1)
                    n[i] += np.bincount(label, minlength=k)
                    np.add.at(s[i], label, own)
        at = np.argwhere(n > 0)
        if len(at):
            yield pd.DataFrame({"state": at[:, 0], "label": at[:, 1], "n": n[tuple(at.T)], "s": list(s[tuple(at.T)])})

    parts = rows.mapInPandas(sums, "state INT, label INT, n DOUBLE, s ARRAY<DOUBLE>")
    total = parts.select("state", "label", "n", F.posexplode("s")).groupBy("state", "label", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    count, sum_ = np.zeros((states, k)), np.zeros((states, k, d))
    for r in total.collect():  # states x clusters x dimensions numbers
        count[r["state"], r["label"]], sum_[r["state"], r["label"], r["pos"]] = r["n"], r["s"]
    return count, sum_


def _means(count: np.ndarray, sums: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count[..., None] > 0, sums / count[..., None], np.nan)


def refit(rows: DataFrame, left_out: list, centers: np.ndarray) -> np.ndarray:
    """Centres of Lloyd's iteration to its end, for every left-out id; ``centers`` start it, by state."""
    centers = centers.copy()
    moving = np.arange(len(left_out))
    for _ in range(MAX_STEPS):
        new = _means(*_step(rows, [left_out[i] for i in moving], centers[moving]))
        same = np.array([np.allclose(a, b, rtol=0, atol=1e-12, equal_nan=True) for a, b in zip(new, centers[moving])])
        centers[moving] = new
        moving = moving[~same]
        if not len(moving):
            break
    return centers


def _without(x: np.ndarray, own: int, centers: np.ndarray, count: np.ndarray, sums: np.ndarray, edge: dict, whole: bool) -> tuple[np.ndarray, bool]:
    """(centres without the row ``x`` of cluster ``own``, whether the boundary rows were enough)."""
    n, s = count.copy(), sums.copy()
    n[own] -= 1
    s[own] -= x
    label, now = edge["label"], _means(n, s)
    skip = (edge["v"] == x).all(1) & (label == own)
    skip[np.flatnonzero(skip)[1:]] = False  # of equal rows one is left out
    for _ in range(MAX_STEPS):
        moved = 2 * np.sqrt(np.nanmax(((now - centers) ** 2).sum(1))) if np.isfinite(now).all() else np.inf
        if not whole and not moved < edge["margin"][-1]:
            return now, False
        reach = int(np.searchsorted(edge["margin"], moved, side="right"))
        new = _distances(edge["v"][:reach], now).argmin(1) if reach else np.empty(0, int)
        base = np.append(new, edge["label"][reach:])
        flips = np.flatnonzero((base != label) & ~skip)
        if not len(flips):
            return now, True
        np.add.at(n, label[flips], -1)
        np.add.at(s, label[flips], -edge["v"][flips])
        np.add.at(n, base[flips], 1)
        np.add.at(s, base[flips], edge["v"][flips])
        label, now = base, _means(n, s)
    return now, True


def cluster_scores(train: DataFrame, k: int = 3, seed: int = 42, boundary_rows: int = BOUNDARY_ROWS) -> DataFrame:
    """``id, cluster_score`` of ``id, v``: exp(-distance to the nearest centre of k-means on the other rows)."""
    rows = cut(train.select("id", "v"))
    fit = KMeans(k=k, seed=seed, featuresCol="f", maxIter=MAX_STEPS, tol=0.0).fit(rows.select(array_to_vector("v").alias("f")))
    centers = refit(rows, [None], np.array([fit.clusterCenters()]))
    count, sums = (x[0] for x in _step(rows, [None], centers))
    centers = _means(count, sums)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(_rows(b["v"]), centers)
                two = np.sort(d, 1)
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "label": d.argmin(1), "margin": two[:, 1] - two[:, 0] if d.shape[1] > 1 else np.inf})

    near = rows.mapInPandas(margins, "id BIGINT, v ARRAY<DOUBLE>, label INT, margin DOUBLE").orderBy("margin", "id").limit(boundary_rows + 1).collect()
    whole, near = len(near) <= boundary_rows, near[:boundary_rows]
    edge = {"v": np.array([r["v"] for r in near], float), "label": np.array([r["label"] for r in near]), "margin": np.array([r["margin"] for r in near])}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, out, ok = _rows(b["v"]), [], []
                for row, own in zip(x, _distances(x, centers).argmin(1)):
                    now, sure = _without(row, own, centers, count, sums, edge, whole)
                    out.append(math.exp(-_distances(row[None], now).min()))
                    ok.append(sure)
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "cluster_score": out, "sure": ok})

    scored = cut(rows.mapInPandas(score, "id BIGINT, v ARRAY<DOUBLE>, cluster_score DOUBLE, sure BOOLEAN"))
    rest = [(r["id"], r["v"]) for r in scored.filter("NOT sure").select("id", "v").collect()] if not whole else []
    found = []
    for lo in range(0, len(rest), REFITS_PER_PASS):
        part = rest[lo : lo + REFITS_PER_PASS]
        for (id_, v), c in zip(part, refit(rows, [i for i, _ in part], np.array([centers] * len(part)))):
            found.append((id_, math.exp(-float(_distances(np.array([v], float), c).min()))))
    out = scored.filter("sure").select("id", "cluster_score")
    return out.unionByName(train.sparkSession.createDataFrame(found, "id BIGINT, cluster_score DOUBLE")) if found else out


# ---- Gaussian mixture

def _parts(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of weight times density, Mahalanobis distance squared, log determinant) by row and component."""
    d = x.shape[1]
    maha, logdet = np.empty((len(x), len(weights))), np.empty(len(weights))
    for i, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        maha[:, i] = (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
        logdet[i] = 2 * np.log(np.diag(low)).sum()
    logs = np.log(np.maximum(weights, 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + logdet + maha)
    return logs, maha, logdet


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top[:, 0] + np.log(np.exp(x - top).sum(1))


def mixture_fit(rows: DataFrame, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, means, covariances with ridge) after one EM iteration over ``rows`` from the given model: sums of rows, collected by component."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = _rows(b["v"])
                logs = _parts(x, weights, means, covs)[0]
                r = np.exp(logs - _log_sum(logs)[:, None])
                own = [np.concatenate([[r[:, i].sum()], r[:, i] @ (u := x - m), ((u * r[:, i : i + 1]).T @ u).ravel()]) for i, m in enumerate(means)]
                total = np.array(own) if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"component": np.arange(len(means)), "s": list(total)})

    parts = rows.mapInPandas(sums, "component INT, s ARRAY<DOUBLE>").select("component", F.posexplode("s"))
    total = parts.groupBy("component", "pos").agg(F.sum("col").alias("s")).collect()  # components x (1 + d + d * d) numbers
    d = means.shape[1]
    flat = np.zeros((len(means), 1 + d + d * d))
    for r in total:
        flat[r["component"], r["pos"]] = r["s"]
    n = flat[:, 0]
    safe = np.maximum(n, 1e-300)[:, None]
    shift = flat[:, 1 : d + 1] / safe
    covs = flat[:, d + 1 :].reshape(-1, d, d) / safe[:, :, None] - shift[:, :, None] * shift[:, None, :] + RIDGE * np.eye(d)
    return n, means + shift, covs


def log_density_without(x: np.ndarray, r: np.ndarray, n: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log density of every row under the mixture of all other rows; ``r`` is the row's share in each component, ``n`` the counts with it.

    Without the row a component has n' = n - r rows, the covariance n / n' (C - r / n' u u^T) for u = x - mean, and x lies n / n' u from its
    mean. With m = u^T C^-1 u the squared distance becomes n m / (n' - r m) and the determinant is scaled by (n / n')^d (1 - r m / n').
    """
    d = x.shape[1]
    _, maha, logdet = _parts(x, np.ones(len(n)), means, covs)
    left = n - r
    with np.errstate(divide="ignore", invalid="ignore"):
        keep = np.maximum(1 - r * maha / left, 1e-12)
        logs = np.log(left / left.sum(1, keepdims=True)) - 0.5 * (d * math.log(2 * math.pi) + d * np.log(n / left) + logdet + np.log(keep) + n / left * maha / keep)
    return _log_sum(np.where(left > 1e-6, logs, -np.inf))


def mixture_scores(train: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``id, log_likelihood`` of ``id, v`` under the mixture of the other rows."""
    rows = cut(train.select("id", "v"))
    model = GaussianMixture(k=k, seed=seed, featuresCol="f").fit(rows.select(array_to_vector("v").alias("f")))
    found = model.gaussiansDF.collect()  # k rows
    start, means = np.array(model.weights), np.array([r["mean"].toArray() for r in found])
    covs = np.array([r["cov"].toArray() for r in found]) + RIDGE * np.eye(means.shape[1])
    n, means1, covs1 = mixture_fit(rows, start, means, covs)

    @F.pandas_udf(T.DoubleType())
    def density(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = _rows(v)
        logs = _parts(x, start, means, covs)[0]
        return pd.Series(log_density_without(x, np.exp(logs - _log_sum(logs)[:, None]), n, means1, covs1))

    return rows.select("id", density("v").alias("log_likelihood"))


# ---- isolation forest

def path_norm(n: float) -> float:
    """Mean depth at which a random tree of n rows isolates a row."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _split(x: np.ndarray, key: tuple[int, int, int]) -> tuple[int, float] | None:
    """A feature that varies and a cut in its range, drawn by (seed, tree, node)."""
    rng = np.random.default_rng(key)
    order, at = rng.permutation(x.shape[1]), rng.random()
    for f in order:
        lo, hi = x[:, f].min(), x[:, f].max()
        if hi > lo:
            return int(f), float(min(lo + at * (hi - lo), np.nextafter(hi, lo)))
    return None


def max_depth(size: int) -> int:
    return max(1, math.ceil(math.log2(max(size, 2))))


def grow(x: np.ndarray, depth: int, seed: int, tree: int, node: int = 1) -> tuple:
    """Random tree as nested tuples (feature, cut, left, right); a leaf is its expected remaining depth."""
    split = _split(x, (seed, tree, node)) if depth and len(x) > 1 else None
    if split is None:
        return (path_norm(len(x)),)
    f, at = split
    left = x[:, f] <= at
    return f, at, grow(x[left], depth - 1, seed, tree, 2 * node), grow(x[~left], depth - 1, seed, tree, 2 * node + 1)


def depths(tree: tuple, x: np.ndarray, at: float = 0.0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), at + tree[0])
    out, left = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[left], out[~left] = depths(tree[2], x[left], at + 1), depths(tree[3], x[~left], at + 1)
    return out


def depth_in(x: np.ndarray, own: np.ndarray, depth: int, seed: int, tree: int) -> float:
    """Depth of the row ``own`` in the tree that ``grow`` makes of ``x``; only its way is followed."""
    node, at = 1, 0
    while depth and len(x) > 1 and (split := _split(x, (seed, tree, node))):
        f, cut_ = split
        right = bool(own[f] > cut_)
        x = x[(x[:, f] > cut_) == right]
        node, at, depth = 2 * node + right, at + 1, depth - 1
    return at + path_norm(len(x))


def normality(mean_depth: np.ndarray, size: int) -> np.ndarray:
    return -np.power(2.0, -mean_depth / (path_norm(size) or 1.0))


def tree_samples(train: DataFrame, n: int, trees: int, seed: int, rows: int) -> DataFrame:
    """``tree, id, v, h``: for each tree about twice ``rows`` of the ``n`` rows, by a hash of the id; its task takes the smallest ``h``."""
    share = 2.0 if n <= 2 * rows else 2.0 * rows / n
    order = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: order(t) < share)
    return train.select("id", "v", F.explode(picks).alias("tree")).withColumn("h", order(F.col("tree")))


def forest_scores(train: DataFrame, trees: int = 100, contamination: float = 0.2, seed: int = 42, tree_rows: int = 256) -> DataFrame:
    """``id, anomaly_score`` of ``id, v`` = (decision + 1) / 2 of an isolation forest grown without the row.

    The trees (``trees`` of at most ``tree_rows`` leaves) travel with the scoring job.
    """
    rows = cut(train.select("id", "v"))
    n = rows.count()

    def grown(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"]).head(tree_rows + 1)  # one more than a tree holds: it replaces a left-out row
        x, t = _rows(pdf["v"]), int(pdf["tree"].iat[0])
        own = x[:tree_rows]
        tree = grow(own, max_depth(len(own)), seed, t)
        without = [depth_in(rest := np.delete(x, i, 0)[:tree_rows], row, max_depth(len(rest)), seed, t) for i, row in enumerate(own)]
        return pd.DataFrame({"tree": [t], "size": [len(own)], "grown": [pickle.dumps(tree)], "ids": [pdf["id"].to_numpy()[:tree_rows]], "change": [without - depths(tree, own)]})

    out = cut(tree_samples(rows, n, trees, seed, tree_rows + 1).groupBy("tree").applyInPandas(
        grown, "tree INT, size INT, grown BINARY, ids ARRAY<BIGINT>, change ARRAY<DOUBLE>"))
    found = out.select("size", "grown").collect()
    forest, size = [pickle.loads(r["grown"]) for r in found], max((r["size"] for r in found), default=0)

    @F.pandas_udf(T.DoubleType())
    def mean_depth(v: pd.Series) -> pd.Series:
        return pd.Series(np.mean([depths(t, _rows(v)) for t in forest], axis=0)) if len(v) else pd.Series([], dtype=float)

    change = out.select(F.explode(F.arrays_zip("ids", "change")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg((F.sum("x.change") / trees).alias("change"))
    scored = cut(rows.select("id", mean_depth("v").alias("depth")).join(change, "id", "left"))
    of = lambda depth, m: -F.pow(F.lit(2.0), -depth / (path_norm(m) or 1.0))
    all_ = scored.select("id", of(F.col("depth"), size).alias("all"), of(F.col("depth") + F.coalesce("change", F.lit(0.0)), min(tree_rows, n - 1)).alias("own"))
    if n < 2:
        return all_.select("id", F.lit(None).cast("double").alias("anomaly_score"))
    # the quantile of the others: of the three order statistics about it, those that are left without the row
    place = contamination * (n - 2)
    j, share = int(place), place - int(place)
    at = {f"s{i}": min(1.0, (j + i) / (n - 1)) for i in range(3)}
    s0, s1, s2 = (quantiles(all_, "all", at).first()[f"s{i}"] for i in range(3))
    low, high = F.when(F.col("all") <= s0, s1).otherwise(s0), F.when(F.col("all") <= s1, s2).otherwise(s1)
    return all_.select("id", ((F.col("own") - (low + share * (high - low)) + 1.0) / 2.0).alias("anomaly_score"))
