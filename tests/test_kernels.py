"""Kernels against brute force, on skewed and degenerate inputs."""

import math

import numpy as np
import pytest

from toposcan.functions.geodesic import inverse_m
from toposcan.operators import components, grid, ordered as o, spatial, vectors


def seg_dist(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def skewed_points(rng, n):
    """A third of the rows on one spot, a third in a tiny cluster, the rest spread, one far away."""
    pts = [(5.0, 5.0)] * (n // 3) + [tuple(rng.normal(50, 0.01, 2)) for _ in range(n // 3)]
    return pts + [tuple(rng.uniform(0, 100, 2)) for _ in range(n - len(pts) - 1)] + [(900.0, -700.0)]


@pytest.mark.parametrize("leaf", [2, 128])
@pytest.mark.parametrize("max_dist", [None, 3.0])
def test_nearest_equals_brute_force(spark, monkeypatch, leaf, max_dist):
    monkeypatch.setattr(spatial, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(1)
    pts = skewed_points(rng, 150)
    base = skewed_points(rng, 90)
    segs = [(x, y, x + dx, y + dy) for (x, y), (dx, dy) in zip(base, rng.normal(0, 2, (90, 2)))] + [(60.0, 1.0, 60.0, 99.0), (7.0, 7.0, 7.0, 7.0)]
    p = spark.createDataFrame([tuple(map(float, q)) for q in pts], "x DOUBLE, y DOUBLE")
    s = spark.createDataFrame([tuple(map(float, q)) for q in segs], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {(r.x, r.y): r.dist for r in spatial.nearest_distance(p, s, max_dist).collect()}
    want = {q: min(seg_dist(*q, *t) for t in segs) for q in {tuple(map(float, q)) for q in pts}}
    if max_dist is not None:
        want = {k: d for k, d in want.items() if d <= max_dist}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_keeps_ties(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "x DOUBLE, y DOUBLE")
    s = spark.createDataFrame([(1.0, 0.0, 1.0, 0.0), (-1.0, 0.0, -1.0, 0.0), (0.0, 2.0, 0.0, 2.0)], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    assert sorted(r.x1 for r in spatial.nearest(p, s).collect()) == [-1.0, 1.0]


def test_nearest_without_segments_or_points(spark):
    p = spark.createDataFrame([(0.0, 0.0)], "x DOUBLE, y DOUBLE")
    none = spark.createDataFrame([], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    assert spatial.nearest_distance(p, none).count() == 0


def test_attach_distance_keeps_rows_without_coordinates(spark):
    p = spark.createDataFrame([(1, -60.0, -3.0), (2, None, None)], "id INT, lon DOUBLE, lat DOUBLE")
    s = spark.createDataFrame([(-60.0, -3.0, -60.0, -4.0)], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {r.id: r.dist_km for r in spatial.attach_distance(p, s).collect()}
    assert got[1] == pytest.approx(0.0, abs=1e-9) and got[2] is None


def test_near_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-5, 5, (80, 2)), rng.uniform(-5, 5, (90, 2))
    da = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "a INT, x DOUBLE, y DOUBLE")
    db = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "b INT, x2 DOUBLE, y2 DOUBLE")
    got = sorted((r.a, r.b) for r in spatial.near_pairs(da, db, 1.3).collect())
    assert got == sorted((i, j) for i in range(80) for j in range(90) if np.hypot(*(a[i] - b[j])) <= 1.3)


def test_ordered_on_skewed_values(spark):
    rng = np.random.default_rng(3)
    vals = [1.0] * 400 + [None] * 50 + [float(x) for x in rng.normal(0, 1, 300)] + [2.0] * 100
    data = [(i, v, i % 7) for i, v in enumerate(vals)]
    df = spark.createDataFrame(data, "id BIGINT, v DOUBLE, w BIGINT").repartition(5)
    for desc in (False, True):
        got = o.ordered(df, "v", "id", desc=desc, sums={"s": "w"}, maxs={"m": "w"}, lags={"prev": "id"}, splits=8).orderBy("rank").collect()
        known = sorted([d for d in data if d[1] is not None], key=lambda d: (-d[1] if desc else d[1], d[0]))
        want = known + sorted([d for d in data if d[1] is None])
        assert [r.id for r in got] == [d[0] for d in want]
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
        assert [r.s for r in got] == list(np.cumsum([d[2] for d in want]))
        assert [r.m for r in got] == list(np.maximum.accumulate([d[2] for d in want]))
        assert [r.prev for r in got] == [None] + [d[0] for d in want[:-1]]


def test_ordered_by_group(spark):
    data = [(i, i % 3 if i % 2 else 0, float(i * 37 % 50)) for i in range(300)]
    df = spark.createDataFrame(data, "id BIGINT, g INT, v DOUBLE")
    got = {(r.g, r["rank"]): r.id for r in o.ordered(df, "v", "id", by=["g"], splits=4).collect()}
    for g in range(3):
        want = sorted([d for d in data if d[1] == g], key=lambda d: (d[2], d[0]))
        assert [got[(g, i + 1)] for i in range(len(want))] == [d[0] for d in want]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_large_quantiles_equal_percentile(spark, by):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(i % 2), float(round(v, 1))) for i, v in enumerate(rng.normal(0, 3, 401))], "g INT, v DOUBLE")
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    small, large = (sorted(map(tuple, o.quantiles(df, "v", probs, by, max_group=m).collect())) for m in (10**9, 0))
    assert np.allclose(small, large)


def test_top_k_block_path_equals_small_path(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (60, 8))
    x[10:30] = x[3]  # copies tie
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id BIGINT, v ARRAY<DOUBLE>")
    for metric in ("cosine", "euclidean"):
        small = sorted(map(tuple, vectors.top_k(df, df, 4, metric, True).collect()))
        monkeypatch.setattr(vectors, "SMALL_ROWS", 5)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
        blocks = sorted(map(tuple, vectors.top_k(df, df, 4, metric, True).collect()))
        few = sorted(map(tuple, vectors.top_k(df.filter("id < 4"), df, 4, metric, True).collect()))
        monkeypatch.undo()
        assert [t[:2] for t in small] == [t[:2] for t in blocks]
        assert np.allclose([t[2] for t in small], [t[2] for t in blocks], atol=1e-6)
        assert [t[:2] for t in few] == [t[:2] for t in small if t[0] < 4]


def test_components_chain_star_and_copies(spark):
    chain = [(i, i + 1) for i in range(100, 260)]
    star = [(1, i) for i in range(2, 60)]
    df = spark.createDataFrame(chain + star + [(5, 5), (300, 301), (301, 300)], "a BIGINT, b BIGINT")
    got = {r.node: r.label for r in components.components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 261))
    assert all(got[i] == 1 for i in range(1, 60))
    assert got[301] == got[300] == 300


def brute_labels(xy, reach, dist):
    label = list(range(len(xy)))
    changed = True
    while changed:
        changed = False
        for i in range(len(xy)):
            for j in range(len(xy)):
                if dist(xy[i], xy[j]) <= reach and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("sphere", [True, False])
def test_link_labels_equals_brute_force(spark, sphere):
    rng = np.random.default_rng(6)
    if sphere:
        xy = [tuple(v) for v in np.concatenate([rng.uniform(-0.012, 0.012, (70, 2)), rng.normal(0.03, 0.0003, (30, 2))]) + [-60.0, -10.0]]
        reach = 200.0
        dist = lambda p, q: float(inverse_m(p[1], p[0], q[1], q[0]))
    else:
        xy = [tuple(v) for v in np.concatenate([rng.uniform(0, 1000, (70, 2)), rng.normal(500, 3, (30, 2))])]
        reach, dist = 60.0, lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy], "x DOUBLE, y DOUBLE")
    got = {(r.x, r.y): r.label for r in components.link_labels(df, reach, sphere).collect()}
    assert same_partition([got[(float(x), float(y))] for x, y in xy], brute_labels(xy, reach, dist))


@pytest.mark.parametrize("connectivity", [4, 8])
def test_label_regions_equals_flood_fill(spark, connectivity):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 3, (14, 17))
    df = spark.createDataFrame([(int(r), int(c), int(g[r, c])) for r in range(14) for c in range(17)], "row INT, col INT, value INT")
    got = sorted((r.value, r.n_cells, r.row_min, r.row_max, r.col_min, r.col_max) for r in components.label_regions(df, connectivity).collect())
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    seen, want = set(), []
    for r0 in range(14):
        for c0 in range(17):
            if (r0, c0) in seen:
                continue
            stack, region = [(r0, c0)], []
            seen.add((r0, c0))
            while stack:
                r, c = stack.pop()
                region.append((r, c))
                for dr, dc in steps:
                    n = (r + dr, c + dc)
                    if 0 <= n[0] < 14 and 0 <= n[1] < 17 and n not in seen and g[n] == g[r0, c0]:
                        seen.add(n)
                        stack.append(n)
            rr, cc = zip(*region)
            want.append((int(g[r0, c0]), len(region), min(rr), max(rr), min(cc), max(cc)))
    assert got == sorted(want)


def test_gaussian_smooth_equals_dense_filter(spark):
    g = np.zeros((9, 12))
    g[0, 0], g[4, 11], g[8, 5] = 1.0, 2.0, 0.5
    sigma, reach = 1.3, int(4 * 1.3 + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    want = g
    for axis in (0, 1):
        padded = np.pad(want, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, padded)
    df = spark.createDataFrame([(int(r), int(c), float(g[r, c])) for r, c in zip(*np.nonzero(g))], "row INT, col INT, value DOUBLE")
    got = np.zeros_like(g)
    for r in grid.gaussian_smooth(df, g.shape, sigma).collect():
        got[r.row, r.col] = r.value
    assert np.allclose(got, want)


def test_geodesic_known_lengths():
    # one degree of latitude at the equator, one of longitude at the equator, quarter meridian
    assert float(inverse_m(0.0, 0.0, 1.0, 0.0)) == pytest.approx(110574.3886, abs=1e-3)
    assert float(inverse_m(0.0, 0.0, 0.0, 1.0)) == pytest.approx(111319.4908, abs=1e-3)
    assert float(inverse_m(0.0, 0.0, 90.0, 0.0)) == pytest.approx(10001965.7293, abs=1e-2)
    assert float(inverse_m(5.0, 7.0, 5.0, 7.0)) == 0.0


def test_silhouette_blocks_equal_one_block(spark, monkeypatch):
    from toposcan.operators.similarity import silhouette

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, int(i % 3), [float(c) for c in rng.normal(i % 3, 1, 4)]) for i in range(45)], "id BIGINT, label INT, v ARRAY<DOUBLE>")
    one = silhouette(df).first()[0]
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 10)
    assert silhouette(df).first()[0] == pytest.approx(one)


def test_infer_type_large_dictionary_equals_small(spark):
    from toposcan.operators.candidates import infer_type

    roots = spark.createDataFrame([(3, "rio", "a"), (1, "io ne", "b"), (2, "lag", "c"), (4, "x", "d")], "ord INT, root STRING, category STRING")
    names = spark.createDataFrame([("rio negro",), ("lagoa",), ("serra",), ("",), ("xrio",)], "normalized_name STRING")
    small, large = (sorted((r.normalized_name, r.type or "") for r in infer_type(names, roots, max_roots=m).collect()) for m in (100, 1))
    assert small == large
    assert dict(small)["rio negro"] == "b" and dict(small)["xrio"] == "a"
