import math

import numpy as np

from lumenfold.llm import vector_join as vj

SCHEMA = "chunk_id long, model_id string, dims int, vector array<float>, cosine string"


def brute(rows, k=5, floor=0.82):
    by = {}
    for i, m, d, v, _ in rows:
        if i is None or m is None or v is None or len(v) != d or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        by.setdefault((m, d), {})[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = set()
    for g in by.values():
        for i, x in g.items():
            c = sorted(((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), j) for j, y in g.items() if j != i))[:k]
            out |= {(i, j) for s, j in c if -s >= floor}
    return out


def data(n=300, d=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=d) * 0.25 if rng.random() < 0.7 else rng.normal(size=d)
        rows.append((i, "ab"[i % 2], d, [float(x) for x in (v * rng.uniform(0.1, 9)).astype(np.float16)], "x"))
    return rows


def run(spark, data_rows, **kw):
    df = spark.createDataFrame(data_rows, SCHEMA)
    return {(r.id, r.other) for r in vj.neighbours(df, **kw).collect()}


def test_exact_over_several_blocks(spark):
    rows = data()
    assert run(spark, rows, rows=40) == brute(rows)


def test_unusable_copies_and_redeliveries(spark):
    rows = data(80)
    v = rows[0][3]
    rows += rows[:7]
    rows += [(1000 + k, "a", 16, v, None) for k in range(9)]  # a crowd of copies: ties go to small ids
    rows += [(2000, "a", 16, None, None), (2001, "a", 16, v[:9], None), (2002, "a", 16, [0.0] * 16, None), (2003, "a", 16, [float("nan")] + v[1:], None), (2004, "a", 16, [float("inf")] + v[1:], None), (2005, "a", 16, [None] + v[1:], None), (None, "a", 16, v, None), (2006, None, 16, v, None)]
    assert run(spark, rows, rows=30) == brute(rows)


def test_without_floor(spark):
    rows = data(60)
    assert run(spark, rows, floor=-2.0, rows=25) == brute(rows, floor=-2.0)


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 24)).astype(np.float32)
    m[7] = 0
    m[7, 3] = 1  # one that fills the scale
    x, q, scale, e = vj.quantised(m)
    assert q.dtype == np.int8
    whole = q.astype(np.int64) @ q.astype(np.int64).T
    assert np.array_equal(whole, q.astype(np.float32) @ q.astype(np.float32).T)
    assert np.abs(x @ x.T - whole * np.outer(scale, scale)).max() <= e * (1 + e) + e + 1e-6


def test_heaps_keep_the_best():
    rng = np.random.default_rng(1)
    names = rng.permutation(100)
    h = vj._Heaps(10, 3)
    pairs = [(int(x), int(y), float(c)) for x, y, c in zip(rng.integers(10, size=900), rng.integers(100, size=900), rng.integers(9, size=900) / 9)]
    pairs = list({(x, y): (x, y, c) for x, y, c in pairs}.values())
    for k in range(0, len(pairs), 50):
        x, y, c = map(np.array, zip(*pairs[k : k + 50]))
        h.add(x, y, c, names)
    for row in range(10):
        want = sorted((-c, names[y]) for x, y, c in pairs if x == row)[:3]
        assert sorted((-c, names[y]) for x, y, c in zip(h.x, h.y, h.c) if x == row) == want


def test_empty(spark):
    assert run(spark, []) == set()


def test_product_on_few_axes_loses_no_pair():
    """Clusters about the floor in 96 dimensions: less than half of the axes are multiplied, no pair at the floor is excluded,
    and few others are computed again; the tile's lists are those of all products."""
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(300, 96)), 4, axis=0)
    m = (centres + rng.normal(size=centres.shape) * rng.uniform(0.1, 0.8, size=(1200, 1))).astype(np.float32)
    m = m[rng.permutation(len(m))]
    m[5] = 0
    m[5, 9] = 1
    a, b = m[:500], m[500:]
    x, y = vj.unit(a), vj.unit(b)
    axes = vj._axes(x, y, 0.82)
    assert axes is not None and axes.shape[1] < 60
    left, right = vj._bounds(x, y, axes, 0.82)
    kept, true = left @ right.T >= 0, x @ y.T >= 0.82
    assert true.sum() > 100 and not (true & ~kept).any() and kept.sum() < true.sum() + 0.01 * kept.size
    names = rng.permutation(1200)
    for tile, rows, others in ((vj._tile(names[:500], a, names[500:], b, 2, 0.82), m, None), (vj._tile(names, m, None, None, 2, 0.82), m, m)):
        c = vj.unit(rows) @ vj.unit(rows).T
        np.fill_diagonal(c, -1)
        if others is None:
            c[:500, :500] = c[500:, 500:] = -1
        want = {(names[p], names[q]) for p in range(1200) for q in sorted(np.flatnonzero(c[p] >= 0.82), key=lambda q: (-round(c[p, q], 12), names[q]))[:2]}
        assert set(zip(tile["x"], tile["y"])) == want


def test_tile_of_many_dimensions_and_of_crowds():
    rng = np.random.default_rng(6)
    wide = np.repeat(rng.normal(size=(60, 400)), 2, axis=0) + rng.normal(size=(120, 400)) * 0.3
    crowd = np.ones((700, 32)) + rng.normal(size=(700, 32)) * 0.05  # each pair reaches the floor
    for m in (wide.astype(np.float32), crowd.astype(np.float32)):
        n = np.arange(len(m))
        got = vj._tile(n, m, None, None, 3, 0.82)
        c = vj.unit(m) @ vj.unit(m).T
        np.fill_diagonal(c, -1)
        want = {(p, q) for p in n for q in sorted(np.flatnonzero(c[p] >= 0.82), key=lambda q: (-round(c[p, q], 12), q))[:3]}
        assert set(zip(got["x"], got["y"])) == want
