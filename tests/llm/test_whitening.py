import math
import random

import numpy as np
import pytest
from macropanel.llm import whitening as W

KIND = "vec_id long, embedding array<float>, x string, n long, component int"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "y", 1, 2) for i, v in vectors], KIND).repartition(parts)


def by_hand(vectors):
    """Covariance of the distinct levels by whole numbers, and the levels."""
    x = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in vectors]
    distinct = sorted({v for _, v in x})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    cov = [[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in distinct) / n**3 for j in range(d)] for i in range(d)]
    return x, n, s, np.array(cov)


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 20)) * np.linspace(1, 9, 20) + 500
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(i, base[0].tolist()) for i in range(900, 1000)] + [(7, base[1].tolist()), (None, base[2].tolist())]
    odd = [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, [])]
    got = W.whiten(W.levels(frame(spark, vectors + odd))).collect()
    x, n, s, cov = by_hand(vectors)
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {n}
    want = sorted((i if i is not None else -1, sum((n * c - t) ** 2 for c, t in zip(v, s))) for i, v in x)
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got if r.component == 5) == want
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    levels = dict(x)
    for r in got:
        if r.vec_id not in (7, None):
            z = (np.array(levels[r.vec_id]) - np.array(s) / n) @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1])
            assert abs(abs(z) - abs(r.whitened)) < 1e-9
            assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    whole = {r.vec_id: [] for r in got if r.vec_id is not None and r.vec_id < 200 and r.vec_id != 7}
    for r in sorted(got, key=lambda r: r.component):
        if r.vec_id in whole:
            whole[r.vec_id].append(r.whitened)
    signs = np.sign(np.array([(np.array(levels[0]) - np.array(s) / n) @ axes[:, k] for k in range(16)]) * np.array(whole[0]))
    for i, w in whole.items():  # one sign for all rows
        assert np.allclose(w * signs, (np.array(levels[i]) - np.array(s) / n) @ axes[:, :16] / np.sqrt(values[:16]), atol=1e-9)


def test_odd_tables(spark):
    assert W.whiten(W.levels(frame(spark, [(1, None), (2, [])]))).count() == 0
    assert W.whiten(W.levels(frame(spark, []))).count() == 0
    one = W.whiten(W.levels(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, k, 1, 0, None, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    # Two lengths, one with a constant part; two distinct vectors have one axis.
    two = W.whiten(W.levels(frame(spark, [(1, [0.0, 5.0]), (2, [2.0, 5.0]), (3, [1.0]), (4, [3.0]), (5, [5.0])]))).collect()
    got = {(r.vec_id, r.component): (r.n, r.deviation, None if r.whitened is None else round(abs(r.whitened), 12), r.explained) for r in two}
    assert got == {
        (1, 1): (2, 128**2, 1.0, 1.0), (1, 2): (2, 128**2, None, 0.0), (2, 1): (2, 128**2, 1.0, 1.0), (2, 2): (2, 128**2, None, 0.0),
        (3, 1): (3, 384**2, round(1.5**0.5, 12), 1.0), (4, 1): (3, 0, 0.0, 1.0), (5, 1): (3, 384**2, round(1.5**0.5, 12), 1.0),
    }


def test_large_parts_stay_exact(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0**32, rng.random() * 2.0**20, rng.random()]) for i in range(60)]
    got = W.whiten(W.levels(frame(spark, vectors)), most=3).collect()
    x, n, s, cov = by_hand(vectors)
    want = {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in x}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in got)
    assert abs({r.component: r.explained for r in got}[1] - cov[0, 0] / np.trace(cov)) < 1e-9
    assert got[0].identity_error < 1e-4


@pytest.mark.parametrize("gap", [1e-3, 1e-9, 1e-12, 0.0])
def test_clustered_eigenvalues_to_double_precision(gap):
    rng, d = np.random.default_rng(8), 24
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(W.Wide)
    for _ in range(3):  # orthogonal in extended precision
        q = q @ (3 * np.eye(d, dtype=W.Wide) - q.T @ q) / 2
    values = np.concatenate([[1 + 3 * gap, 1 + 2 * gap, 1 + gap, 1], np.linspace(0.7, 0.01, d - 4)]).astype(W.Wide)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, axes = W.refined_eigen(a)
    assert np.abs(found - values).max() < 1e-17
    assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-17
    assert np.abs(a @ axes - axes * found).max() < 2e-18 * 10
    if gap:
        near = np.abs(np.abs(axes.T @ q) - np.eye(d)).max()
        assert near < max(1e-16, 1e-17 / gap)


def test_quotient():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.randrange(-(10 ** rng.randrange(1, 40)), 10 ** rng.randrange(1, 40)), rng.randrange(1, 10 ** rng.randrange(1, 30))
        got = W.quotient(a, b)
        assert abs(float(got) - a / b) <= abs(a / b) * 3e-16
    assert W.quotient(0, 7) == 0 and W.quotient(3, 3) == 1
