"""Nearest vectors by the index of cells against all pairs."""

import numpy as np
import pandas as pd
import pytest

from toposcan.operators import metric_index as M, vectors


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>").repartition(3)


def brute(q, m, k, metric, skip_self):
    if metric == "cosine":
        unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1.0, n)
        s = unit(q) @ unit(m).T
    else:
        s = -np.sqrt(((q[:, None] - m[None]) ** 2).sum(2))
    out = []
    for i, row in enumerate(np.round(s, 9)):
        rows = sorted((-x, j) for j, x in enumerate(row) if not (skip_self and i == j))[:k]
        out += [(i, j, round(-x, 9) + 0.0) for x, j in rows]
    return sorted(out)


def data(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "blobs":
        x = rng.normal(size=(n, 4)) + rng.normal(0, 20, (12, 4))[rng.integers(0, 12, n)]
    elif kind == "grid":  # ties everywhere
        x = rng.integers(0, 4, (n, 3)).astype(float)
    elif kind == "copies":  # a third of all rows are one vector, and there are zeros
        x = rng.normal(size=(n, 3))
        x[: n // 3] = x[0]
        x[n // 3 : n // 3 + 9] = 0.0
    else:  # no bound helps
        x = rng.normal(size=(n, 64))
    return x[rng.permutation(n)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("kind", ["blobs", "grid", "copies", "noise"])
def test_equal_to_all_pairs(spark, monkeypatch, kind, metric):
    for name, value in (("CELL_ROWS", 24), ("QUERY_ROWS", 20), ("WIDTHS", (2,)), ("PIVOTS", 30)):
        monkeypatch.setattr(M, name, value)
    m, q = data(kind, 260, 1), data(kind, 130, 2)
    q[:20] = m[:20]
    for k, other, skip in ((5, q, False), (3, m, True)):
        got = sorted((r.query_id, r.id, round(r.score, 9) + 0.0) for r in M.top_k(frame(spark, other), frame(spark, m), k, metric, skip).collect())
        assert got == brute(other, m, k, metric, skip)


def test_few_rows_and_none(spark):
    m = data("blobs", 4, 3)
    got = M.top_k(frame(spark, m), frame(spark, m), 9, "euclidean", True).collect()
    assert len(got) == 12
    empty = frame(spark, m).limit(0)
    assert M.top_k(frame(spark, m), empty, 3, "cosine").count() == 0
    assert M.top_k(empty, frame(spark, m), 3, "cosine").count() == 0


def test_large_sides_take_the_index_and_ask_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 50, (40, 6))
    x = rng.normal(size=(4_000, 6)) + centers[np.arange(4_000) % 40]
    asked = []
    plain = M._meet
    monkeypatch.setattr(M, "CELL_ROWS", 400)
    monkeypatch.setattr(M, "_meet", lambda asking, rows, cells, load, *a: asked.append((sum(load.values()), len(cells.rows))) or plain(asking, rows, cells, load, *a))
    df = frame(spark, x)
    assert vectors.SMALL_ROWS < 4_000
    got = {r.id: r.knn_score for r in vectors.knn_score(df, df, 3, leave_one_out=True).collect()}
    assert len(got) == 4_000
    for i in range(0, 4_000, 500):
        d = np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[1:4]
        assert got[i] == pytest.approx(np.exp(-d.mean()), abs=1e-8)
    assert sum(n for n, _ in asked) < 0.2 * 4_000 * asked[0][1]  # a fifth of what all blocks against all would be


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_shelves_and_parts(spark, monkeypatch, metric):
    """Small shelves: cells share one or are cut into parts, and queries come back to a shelf in later rounds."""
    for name, value in (("CELL_ROWS", 8), ("QUERY_ROWS", 8), ("WIDTHS", (3,)), ("PIVOTS", 12), ("BLOCK_BYTES", 8 * 64 * 20), ("SHELF_CELLS", 3)):
        monkeypatch.setattr(M, name, value)
    m = np.vstack([data("noise", 150, 4), np.tile(data("noise", 1, 5), (6, 1)), 1e4 + 1e-5 * data("noise", 40, 6)])  # far from the origin, near each other
    got = sorted((r.query_id, r.id, round(r.score, 9) + 0.0) for r in M.top_k(frame(spark, m), frame(spark, m), 3, metric, True).collect())
    if metric == "euclidean":
        assert got == brute(m, m, 3, metric, True)
    assert len(got) == 3 * len(m)


def test_meeting_hands_on_what_improves():
    """A query in a meeting yields rows that reach the score it has, of the cells it asks; not its best rows of every cell."""
    m = data("noise", 300, 7)
    q, bit = m[:40] + 0.01, np.arange(300) % 3
    d = np.round(np.sqrt(((q[:, None] - m[None]) ** 2).sum(2)), 9)
    rows = pd.DataFrame({"v": list(m), "ids": [[i] for i in range(300)], "bit": bit})
    for known in (-np.inf, -11.0):
        asks = pd.DataFrame({"key": [f"q{i:02}" for i in range(40)], "v": list(q), "bits": [1 + i % 7 for i in range(40)], "score": known})
        got = M._pair("euclidean", 2)(asks, rows)
        want = []
        for i in range(40):
            asked = [j for j in range(300) if (1 + i % 7) >> bit[j] & 1 and -d[i, j] >= known]
            want += [(f"q{i:02}", j, -d[i, j]) for j in sorted(asked, key=lambda j: (d[i, j], j))[:2]]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_the_screen_finds_what_nonzero_finds():
    rng = np.random.default_rng(3)
    for shape in ((5, 7), (1, 1), (3, 0), (0, 4)):
        mask = rng.random(shape) < 0.4
        for got, want in zip(M._where(mask), np.nonzero(mask)):
            assert got.tolist() == want.tolist()
