import math

import numpy as np

from qacorpus.llm import block_neighbours as B


def _brute(rows, k, every):
    ok = {i: [float(np.float32(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in ok:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(ok[q], v)), c) for c, v in ok.items() if c != q and len(v) == len(ok[q]))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])]
    return sorted(out)


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    a, b = rnd.normal(size=(30, 64)), rnd.normal(size=(50, 64)) * np.exp(rnd.normal(size=(50, 1)) * 3)
    low, high = B.tile_bounds(B.Quantised(a), B.Quantised(b))
    true = a @ b.T
    assert (low <= true).all() and (true <= high).all() and np.median(high - low) < 0.05 * np.median(np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)))


def test_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(300)]
    for i in range(40, 140):
        rows[i] = (i, rows[0][1])  # a common vector: ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (None, [1.0] * 8), (320, [1.0, 2.0]), (321, [1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, q int, score string").repartition(3)
    for how in ({}, {"block": 50, "queries_at_once": 4}, {"k": 400}):
        got = sorted(tuple(r) for r in B.nearest(df, every=20, **how).collect())
        want = _brute(rows, how.get("k", 20), 20)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14, atol=1e-14)
    assert B.nearest(df.filter("false")).count() == 0
    twice = B.nearest(df.union(df), every=20)
    assert sorted(tuple(r) for r in twice.collect()) == sorted(tuple(r) for r in B.nearest(df, every=20).collect())


def test_large_and_small_magnitudes(spark):
    rnd = np.random.default_rng(2)
    for size in (1e155, 1e-160, 1e20):
        rows = [(i, (rnd.normal(size=4) * size).tolist()) for i in range(101)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted(tuple(r) for r in B.nearest(df, every=50).collect())
        ok = dict(rows)
        want = []
        for q in (0, 50, 100):
            scored = []
            for c, v in rows:
                if c != q:
                    s = 0.0
                    for a, b in zip(ok[q], v):
                        s += a * b
                    scored.append((-s if s == s else math.inf, c))
            want += [(q, r + 1, c) for r, (_, c) in enumerate(sorted(scored)[:20])]
        assert [g[:3] for g in got] == sorted(want)
