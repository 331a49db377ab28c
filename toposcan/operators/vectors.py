"""Nearest vectors: exact top-k by cosine similarity or Euclidean distance, and name embeddings.

A side that is proven small travels with the job; otherwise an index of cells is asked (:mod:`toposcan.operators.metric_index`). Pairs never become
rows: a meeting of two blocks yields k rows per query.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.functions import text
from toposcan.operators import metric_index

SMALL_ROWS = 2048  # rows of a side that may travel with the job
SMALL_BYTES = 32 << 20
BLOCK_ROWS = 8192  # rows of a block, and more in tables of many blocks
BLOCK_BYTES = 32 << 20

# Words that nudge an embedding.
TERRAIN_WORDS = ["serra", "monte", "pico", "vale", "planalto"]
SETTLEMENT_WORDS = ["cidade", "vila", "povoado", "aldeia", "comunidade"]
WORD_GROUPS = [(0.5, text.WATER_SEEDS), (0.3, TERRAIN_WORDS), (0.2, SETTLEMENT_WORDS)]

OUT = "query_id BIGINT, id BIGINT, score DOUBLE"


def _matrix(col: pd.Series, metric: str) -> np.ndarray:
    m = np.array(col.tolist(), dtype=float)
    if metric == "cosine":
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(norm == 0, 1.0, norm)
    return m


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, metric: str, skip_self: bool) -> pd.DataFrame:
    """The k best of ``ids`` for every query; larger scores are better (a distance is negated)."""
    frames = []
    step = 256 if metric == "cosine" else max(1, min(256, int(2e7 // max(1, m.size))))
    for lo in range(0, len(q), step):
        part, part_ids = q[lo:lo + step], q_ids[lo:lo + step]
        # distances by differences at every size: the expanded square cancels for near vectors
        s = part @ m.T if metric == "cosine" else -np.sqrt(((part[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
        s = np.round(s, 9)  # copies of a vector tie, whatever the order of summation
        if skip_self:
            s[part_ids[:, None] == ids[None, :]] = -np.inf
        for row, qid in zip(s, part_ids):
            good = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
            take = good[np.lexsort((ids[good], -row[good]))[:k]]  # ties at the k-th place are decided by id
            take = take[np.isfinite(row[take])]
            frames.append((np.full(len(take), qid), ids[take], row[take]))
    if not frames:
        return pd.DataFrame({"query_id": [], "id": [], "score": []})
    a, b, c = (np.concatenate(x) for x in zip(*frames))
    return pd.DataFrame({"query_id": a, "id": b, "score": c})


def _local(df: DataFrame) -> tuple[np.ndarray, pd.Series] | None:
    """Ids and vectors of a side if it is small, else None. The limit is checked before anything large moves."""
    head = df.limit(SMALL_ROWS + 1).select("id", F.size("v").alias("d"))
    n, d = head.agg(F.count(F.lit(1)), F.max("d")).first()
    if n == 0 or n > SMALL_ROWS or n * d * 8 > SMALL_BYTES:
        return None
    pdf = df.toPandas()
    return pdf["id"].to_numpy(), pdf["v"]


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """``query_id, id, score`` of the k best index rows per query. Both inputs are ``id BIGINT, v ARRAY<DOUBLE>``."""
    small = _local(index)
    if small is not None:
        ids, vec = small
        m = _matrix(vec, metric)

        def against_index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield _best(b["id"].to_numpy(), _matrix(b["v"], metric), ids, m, k, metric, skip_self)

        return queries.mapInPandas(against_index, OUT)
    small = _local(queries)
    if small is not None:
        q_ids, vec = small
        q = _matrix(vec, metric)

        def against_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield _best(q_ids, q, b["id"].to_numpy(), _matrix(b["v"], metric), k, metric, skip_self)

        return _merge(index.mapInPandas(against_queries, OUT), k)
    return metric_index.top_k(queries, index, k, metric, skip_self)


def _merge(parts: DataFrame, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return parts.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def cosine_topk(queries: DataFrame, index: DataFrame, k: int = 5, min_sim: float = 0.1) -> DataFrame:
    """``query_id, id, similarity`` of the k most similar vectors with at least ``min_sim``."""
    return top_k(queries, index, k).filter(F.col("score") >= min_sim).withColumnRenamed("score", "similarity")


def water_scores(vectors: DataFrame, seeds: DataFrame, k: int = 3) -> DataFrame:
    """``id, water_score``: mean cosine similarity to the k nearest seeds."""
    near = top_k(vectors, seeds, k)
    return near.groupBy(F.col("query_id").alias("id")).agg(F.avg("score").alias("water_score"))


def knn_score(test: DataFrame, train: DataFrame, k: int = 3, leave_one_out: bool = False) -> DataFrame:
    """``id, knn_score`` = exp(-mean distance to the k nearest); leave-one-out skips the row itself."""
    near = top_k(test, train, k, "euclidean", skip_self=leave_one_out)
    return near.groupBy(F.col("query_id").alias("id")).agg(F.exp(F.avg("score")).alias("knn_score"))


def digits_vector(name: Column, dim: int, seed: int) -> Column:
    """Unit vector of a text from the digits of md5('seed:block:text'): four hex digits per component, scaled to [-1, 1]."""
    blocks = [F.md5(F.concat(F.lit(f"{seed}:{b}:"), name)) for b in range(-(-dim // 8))]
    part = lambda h, i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535.0 * 2.0 - 1.0
    return unit_vector(once(F.concat(*blocks), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: part(h, i))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit_vector(v: Column) -> Column:
    """A vector scaled to length 1; zeros stay."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return once(v, lambda a: once(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))))


def hash_embedding(dim: int = 512, seed: int = 42):
    """Column function: unit vector per text, fixed by the text; words of water, terrain and settlement nudge it.

    Built-in expressions only. A nudging word adds its own vector with the weight of its group.
    """

    def digits(word: str) -> np.ndarray:
        text_ = "".join(hashlib.md5(f"{seed}:{b}:{word}".encode()).hexdigest() for b in range(-(-dim // 8)))
        x = np.array([int(text_[4 * i : 4 * i + 4], 16) for i in range(dim)]) / 65535.0 * 2.0 - 1.0
        return x / np.linalg.norm(x)

    nudges: dict[str, list[float]] = {}
    for weight, words in WORD_GROUPS:
        for word in words:
            nudges.setdefault(word, (weight * digits(word)).tolist())

    def embed(name: str | Column) -> Column:
        name = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
        known = list(nudges)
        table = F.array(*[F.lit(nudges[w]) for w in known])
        hits = F.filter(F.split(name, " "), lambda w: w.isin(known))
        zero = F.array_repeat(F.lit(0.0), dim)
        shift = F.aggregate(hits, zero, lambda s, w: F.zip_with(s, F.get(table, (F.array_position(F.lit(known), w) - 1).cast("int")), lambda x, y: x + y))
        base = digits_vector(name, dim, seed)
        both = F.zip_with(base, unit_vector(shift), lambda x, y: 0.7 * x + 0.3 * y)
        return F.when(F.size(hits) > 0, unit_vector(both)).otherwise(base)

    return embed


def block_sums(rows: DataFrame, n_labels: int) -> DataFrame:
    """``id, other, total``: sum of Euclidean distances of every row to all rows of each label.

    ``rows`` is ``id, labels ARRAY<INT>, v``; a row may have several labels, one per labelling, whose distances are measured once.
    Every block meets every block, so a row travels as often as there are blocks: they grow with the table up to ``BLOCK_BYTES``.
    A block pair yields one row per id and label.
    """
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width or 1, n_labels)))
    spread = math.ceil(2 * math.sqrt(rows.sparkSession.sparkContext.defaultParallelism))
    n = max(1, math.ceil(count / min(most, max(BLOCK_ROWS, math.ceil(count / spread)))))
    block = F.pmod(F.xxhash64("id"), F.lit(n))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = rows.select("id", "v", block.alias("qb"), every.alias("ib"))
    right = rows.select("labels", "v", block.alias("ib"), every.alias("qb"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not (len(a) and len(b)):
            return pd.DataFrame({"id": [], "other": [], "total": []})
        m, q = _matrix(b["v"], "euclidean"), _matrix(a["v"], "euclidean")
        onehot = np.zeros((len(m), n_labels))
        for row, labels in enumerate(b["labels"]):
            onehot[row, labels] = 1.0
        m2, sums = (m**2).sum(1)[None, :], np.empty((len(q), n_labels))
        step = max(1, min(256, (8 << 20) // len(m)))
        for lo in range(0, len(q), step):
            part = q[lo:lo + step]
            d2 = (part**2).sum(1)[:, None] - 2 * part @ m.T + m2
            sums[lo:lo + step] = np.sqrt(np.maximum(d2, 0.0)) @ onehot
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), n_labels), "other": np.tile(np.arange(n_labels), len(q)), "total": sums.ravel()})

    parts = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(pair, "id BIGINT, other INT, total DOUBLE")
    return parts.groupBy("id", "other").agg(F.sum("total").alias("total"))
