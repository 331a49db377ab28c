"""Exact nearest vectors by an index of cells, for two sides that are both large.

Index rows belong to the cell of their nearest pivot. A cell knows how near and how far its rows lie from the pivot, so the triangle inequality
bounds from below what it can hold for a query. A query asks its cells by rising bound, in rounds of more and more cells, and stops when the k-th
best score beats the next bound. On data that no bound can cut (random directions in many dimensions) it ends up asking all cells, which is what an
exact answer takes there.

- Equal vectors are one index row with their smallest ids and one query, however many copies there are.
- Cells that lie near each other share a shelf of up to ``BLOCK_BYTES``; a query travels once per round to each shelf that holds some of its cells, not
  once per cell. Shelves meet blocks of queries; a cell larger than a shelf is cut into parts. No task holds more than one shelf and one block.
- A meeting screens all pairs by one matrix product with a bound on its error and the score that the query must beat. Only pairs that pass are
  measured by differences, so a meeting hands on the few rows that improve a query.
- ``PIVOTS`` vectors at most travel with the jobs, and two numbers per cell.

Scores are rounded to nine places and ties decided by id, as in :func:`toposcan.operators.vectors.top_k`; bounds allow for the rounding.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from toposcan.session import cut

PIVOTS = 1024
CELL_ROWS = 4096  # rows of a shelf at least; a cell has about a quarter
QUERY_ROWS = 4096  # queries of a block at least
BLOCK_BYTES = 16 << 20  # of the vectors of a shelf or a block, at most
SHELF_CELLS = 62  # cells of a shelf are bits of a long
#: Cells that a query asks in the rounds after the first; then all that are left.
WIDTHS = (16,)
SLACK = 2e-9
MAX_TASKS = 4096
STEP_PAIRS = 8 << 20  # pairs screened at once
STEP_NUMBERS = 16 << 20  # numbers of the differences measured at once
FOUND = "key STRING, id BIGINT, score DOUBLE"


def _prepared(df: DataFrame, metric: str, side: int) -> DataFrame:
    """``id, key, v``: vectors as compared. For the cosine they are scaled to length 1; zeros get a direction of their own on each side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.array(b["v"].tolist(), dtype=float) + 0.0
                if metric == "cosine":
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.hstack([m / np.where(norm == 0, 1.0, norm), np.zeros((len(m), 2))])
                    m[norm[:, 0] == 0, m.shape[1] - 1 - side] = 1.0
                keys = [hashlib.blake2b(row.tobytes(), digest_size=16).hexdigest() for row in m]
                yield pd.DataFrame({"id": b["id"], "key": keys, "v": list(m)})

    return df.select("id", "v").mapInPandas(run, "id BIGINT, key STRING, v ARRAY<DOUBLE>")


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return np.round(q @ m.T, 9)
    out = np.empty((len(q), len(m)))
    step = max(1, int(2e7 // max(1, m.size)))
    for lo in range(0, len(q), step):
        out[lo : lo + step] = -np.sqrt(((q[lo : lo + step, None, :] - m[None, :, :]) ** 2).sum(2))
    return np.round(out, 9)


def _lengths(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences: an expanded square cancels for near vectors."""
    return -_scores(x, pivots, "euclidean")


def _reach(score: np.ndarray, metric: str) -> np.ndarray:
    """Distance within which a row can still have this score or a better one."""
    if metric == "cosine":
        return np.sqrt(np.maximum(0.0, 2 - 2 * (score - SLACK))) + SLACK
    return -score + SLACK


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest that is left."""
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        d = np.where(left, _lengths(pivots[order[-1]][None], pivots)[0], np.inf)
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return order


class Cells:
    """Pivots with the least and greatest distance and the number of rows of their cells, and the shelves of up to ``shelf_rows`` rows."""

    def __init__(self, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, shelf_rows: int = CELL_ROWS) -> None:
        self.pivots, self.low, self.high, self.rows = pivots, low, high, rows
        self.shelf, self.bit, self.parts = np.zeros(len(rows), int), np.zeros(len(rows), int), []
        held, n = 0.0, 0
        for c in _chain(pivots) if len(rows) else ():
            if not self.parts or held + rows[c] > shelf_rows or n == SHELF_CELLS:
                self.parts.append(1)
                held, n = 0.0, 0
            self.shelf[c], self.bit[c] = len(self.parts) - 1, n
            held, n = held + rows[c], n + 1
            self.parts[-1] = max(1, math.ceil(held / shelf_rows))

    def shelves(self, cells: np.ndarray) -> tuple[list[int], list[int]]:
        """The shelves that hold ``cells``, and for each the bits of its cells among them."""
        at = self.shelf[cells]
        found, place = np.unique(at, return_inverse=True)
        bits = np.zeros(len(found), np.int64)
        np.bitwise_or.at(bits, place, np.left_shift(np.int64(1), self.bit[cells].astype(np.int64)))
        return found.tolist(), bits.tolist()

    def ask(self, q: np.ndarray, asked: np.ndarray, score: np.ndarray, width: int | None, want: int, metric: str) -> list[np.ndarray]:
        """The next cells of every query: in the first round as many as hold ``want`` rows, then up to ``width`` whose bound is within reach."""
        d = _lengths(q, self.pivots)
        bound = np.maximum(np.maximum(d - self.high, self.low - d), (d - d.min(1, keepdims=True)) / 2) - SLACK
        bound[:, self.rows == 0] = np.inf
        order = np.argsort(bound, 1, kind="stable")
        out = []
        for row, b, m, limit in zip(order, bound, asked, _reach(score, metric)):
            if width is None:
                n = int(np.searchsorted(np.cumsum(self.rows[row]), want)) + 1
            else:
                n = int(np.searchsorted(b[row], limit, side="right")) - m
                n = n if width < 0 else min(n, width)
            out.append(row[m : m + max(n, 0)])
        return out


def _block(df: DataFrame, n: int, least: int, width: int) -> int:
    """Rows of a block: some blocks per core of a small table, and no more than ``BLOCK_BYTES`` of a large one."""
    spread = math.ceil(2 * math.sqrt(df.sparkSession.sparkContext.defaultParallelism))
    return max(1, min(max(least, -(-n // spread)), max(least, BLOCK_BYTES // (8 * max(width, 1)))))


def _index(index: DataFrame, want: int, metric: str) -> tuple[DataFrame, Cells]:
    """Distinct index vectors ``key, v, ids, shelf, bit, part`` and the cells."""
    own = Window.partitionBy("key").orderBy("id")
    few = _prepared(index, metric, 0).withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= want)  # limited before the shuffle
    distinct = cut(few.groupBy("key").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    n = distinct.count()
    if not n:
        return distinct, Cells(*[np.empty(0)] * 4)
    pivots = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("key"), "key").limit(max(1, min(PIVOTS, n // (CELL_ROWS // 4)))).collect()], float)

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _lengths(np.array(b["v"].tolist()), pivots)
                yield b.assign(cell=d.argmin(1), dist=d.min(1))

    rows = cut(distinct.mapInPandas(cell, "key STRING, v ARRAY<DOUBLE>, ids ARRAY<BIGINT>, cell INT, dist DOUBLE"))
    low, high, size = (np.zeros(len(pivots)) for _ in range(3))
    for r in rows.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")).collect():
        low[r["cell"]], high[r["cell"]], size[r["cell"]] = r["lo"], r["hi"], r["n"]
    cells = Cells(pivots, low, high, size, _block(index, n, CELL_ROWS, pivots.shape[1]))
    rows = rows.select("key", "v", "ids", _at(cells.shelf, "cell").alias("shelf"), _at(cells.bit, "cell").alias("bit"))
    return rows.withColumn("part", F.pmod(F.xxhash64("key"), _at(cells.parts, "shelf")).cast("int")), cells


def _at(table: Sequence[int], col: str) -> Column:
    return F.get(F.array(*[F.lit(int(x)) for x in table]), F.col(col))


def _measured(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Rounded scores of pairs, row by row."""
    out = np.empty(len(q))
    step = max(1, STEP_NUMBERS // max(1, q.shape[1]))
    for lo in range(0, len(q), step):
        a, b = q[lo : lo + step], m[lo : lo + step]
        out[lo : lo + step] = (a * b).sum(1) if metric == "cosine" else -np.sqrt(((a - b) ** 2).sum(1))
    return np.round(out, 9)


def _first(group: np.ndarray, n: int) -> np.ndarray:
    """Which of the sorted groups' members are among their first ``n``."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group)))) < n


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few hits, which looks at the entries one by one there; flat it skips what is empty."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def _improving(q: np.ndarray, m: np.ndarray, m2: np.ndarray, allowed: np.ndarray, bit: np.ndarray, score: np.ndarray, want: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs that may be among the ``want`` best of a query in its ``allowed`` cells and reach its ``score``.

    One product yields the square of the distance less that of the query (or the negated cosine); ``err`` bounds its error. ``m2`` are the squared
    lengths of the rows ``m``, which end with them if the metric is Euclidean.
    """
    q2 = (q**2).sum(1)
    err = 4 * (q.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(q2) + np.sqrt(m2.max())) ** 2
    if metric == "cosine":
        s, limit = -(q @ m.T), -score + SLACK + err
    else:
        s = np.hstack([-2 * q, np.ones((len(q), 1))]) @ m.T
        limit = (-score + SLACK) ** 2 - q2 + err
    few = len(m) <= want
    if not few and (np.isinf(limit).any() or np.count_nonzero(s <= limit[:, None]) > 64 * want * len(q)):
        s[~allowed[:, bit]] = np.inf
        kth = np.partition(s, want - 1, axis=1)[:, want - 1]
        with np.errstate(invalid="ignore"):
            near = kth + 2 * SLACK + err if metric == "cosine" else (np.sqrt(np.maximum(kth + q2 + err, 0.0)) + SLACK) ** 2 - q2 + err
        limit = np.where(np.isinf(kth), limit, np.minimum(limit, near))
    i, j = _where(s <= limit[:, None])
    own = allowed[i, bit[j]]
    return i[own], j[own]


def _pair(metric: str, want: int):
    """Meeting of a block of queries ``key, v, bits, score`` with a shelf ``v, ids, bit``: the best rows of every query that reach its score."""

    def run(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(rows):
            q, rows = q.sort_values(["bits", "key"]), rows.sort_values("bit", kind="stable")
            m, bit, ids = np.array(rows["v"].tolist()), rows["bit"].to_numpy(), rows["ids"].to_numpy()
            first, copies = np.array([i[0] for i in ids]), np.array([len(i) for i in ids])
            qs, bits, score, keys = np.array(q["v"].tolist()), q["bits"].to_numpy(), q["score"].to_numpy(), q["key"].to_numpy(object)
            centre = m.mean(0) if metric == "euclidean" else 0.0  # the product cancels less
            mc, qc = m - centre, qs - centre
            m2 = (mc**2).sum(1)
            mc = np.hstack([mc, m2[:, None]]) if metric == "euclidean" else mc
            allowed = (bits[:, None] >> np.arange(SHELF_CELLS)) & 1 > 0
            step = max(1, min(256, STEP_PAIRS // len(m)))
            for lo in range(0, len(qs), step):
                at = slice(lo, lo + step)
                some = np.flatnonzero(allowed[at].any(0)[bit])
                if not len(some):
                    continue
                part, part2 = (mc, m2) if len(some) == len(m) else (mc[some], m2[some])
                i, j = _improving(qc[at], part, part2, allowed[at], bit[some], score[at], want, metric)
                i, j = i + lo, some[j]
                s = np.empty(len(i))
                chunk = max(1, STEP_NUMBERS // max(1, m.shape[1]))
                for c in range(0, len(i), chunk):
                    s[c : c + chunk] = _measured(qs[i[c : c + chunk]], m[j[c : c + chunk]], metric)
                reached = s >= score[i]
                i, j, s = i[reached], j[reached], s[reached]
                if not len(i):
                    continue
                order = np.lexsort((first[j], -s, i))  # of equal scores the smallest ids
                i, j, s = i[order], j[order], s[order]
                keep = _first(i, want)
                i, j, s = i[keep], j[keep], s[keep]
                n = copies[j]
                i, s, id_ = np.repeat(i, n), np.repeat(s, n), np.concatenate([ids[x] for x in j])
                order = np.lexsort((id_, -s, i))
                i, s, id_ = i[order], s[order], id_[order]
                keep = _first(i, want)
                out.append((keys[i[keep]], id_[keep], s[keep]))
        key, id_, s = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pd.DataFrame({"key": pd.Series(key, dtype=object), "id": id_, "score": s})

    return run


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return found.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def top_k(queries: DataFrame, index: DataFrame, k: int, metric: str, skip_self: bool = False) -> DataFrame:
    """``query_id, id, score`` of the k best index rows per query (``id BIGINT, v ARRAY<DOUBLE>`` both)."""
    want = k + skip_self
    rows, cells = _index(index, want, metric)
    prepared = cut(_prepared(queries, metric, 1))
    state = prepared.groupBy("key").agg(F.any_value("v").alias("v")).withColumns({"asked": F.lit(0), "score": F.lit(float("-inf"))})
    best = None
    for width in (None, *WIDTHS, -1) if len(cells.rows) else ():

        def ask(batches: Iterator[pd.DataFrame], width=width) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    next_ = cells.ask(np.array(b["v"].tolist()), b["asked"].to_numpy(), b["score"].to_numpy(), width, want, metric)
                    some = [len(c) > 0 for c in next_]
                    at = [cells.shelves(c) for c in next_ if len(c)]
                    out = b.assign(asked=b["asked"] + [len(c) for c in next_])[some]
                    if len(out):
                        yield out.assign(shelves=[x for x, _ in at], bits=[x for _, x in at])

        asking = cut(state.mapInPandas(ask, "key STRING, v ARRAY<DOUBLE>, asked INT, score DOUBLE, shelves ARRAY<INT>, bits ARRAY<BIGINT>"))
        load = {r["shelf"]: r["n"] for r in asking.select(F.explode("shelves").alias("shelf")).groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not load:
            break
        found = _meet(asking, rows, cells, load, want, metric)
        best = cut(_best(found if best is None else best.unionByName(found), "key", want))
        # the score to beat: only of queries that have as many rows as they want
        last = best.groupBy("key").agg(F.when(F.count(F.lit(1)) == want, F.min("score")).otherwise(F.lit(float("-inf"))).alias("score"))
        state = asking.select("key", "v", "asked").join(last, "key")
    pairs = prepared.select(F.col("id").alias("query_id"), "key").join(best, "key").drop("key") if best is not None else prepared.select(
        F.col("id").alias("query_id"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("score")).limit(0)
    return _best(pairs.filter(F.col("id") != F.col("query_id")), "query_id", k) if skip_self else pairs


def _meet(asking: DataFrame, rows: DataFrame, cells: Cells, load: dict[int, int], want: int, metric: str) -> DataFrame:
    """Best rows of the asked cells; shelves meet their queries in blocks."""
    most = _block(asking, max(load.values()), QUERY_ROWS, cells.pivots.shape[1])
    blocks = [-(-load.get(s, 0) // most) for s in range(len(cells.parts))]
    up_to = lambda table: F.explode(F.sequence(F.lit(0), _at(table, "shelf") - 1))
    q = asking.select("key", "v", "score", F.explode(F.arrays_zip("shelves", "bits")).alias("s")).select("key", "v", "score", "s.bits", F.col("s.shelves").alias("shelf"))
    q = q.withColumn("block", F.pmod(F.xxhash64("key"), _at(blocks, "shelf")).cast("int")).withColumn("part", up_to(cells.parts))
    r = rows.filter(_at(blocks, "shelf") > 0).select("v", "ids", "bit", "shelf", "part", up_to(blocks).alias("block"))
    keys = ("shelf", "part", "block")
    tasks = min(max(sum(a * b for a, b in zip(cells.parts, blocks)), rows.sparkSession.sparkContext.defaultParallelism), MAX_TASKS)
    q, r = (d.repartition(tasks, *keys) for d in (q, r))  # by the number of meetings, whatever the bytes of the input
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_pair(metric, want), FOUND)
