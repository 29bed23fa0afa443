import numpy as np
import pytest
from edge import clashing

from mkpulse.llm import whitening as S

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8, scale=1024):
    """Eigenvectors of the covariance, written out."""
    rows = [(i, e) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dim = max(len(e) for _, e in rows)
    x = [[int(np.floor(scale * float(c))) + 100000 for c in [*e, *[0.0] * (dim - len(e))]] for _, e in rows]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    a = np.array(x, float) - np.array(sums) / n
    w, v = np.linalg.eigh(a.T @ a / n)
    return rows, n, dev, a, w[::-1], v.T[::-1]


def got(frame, **how):
    out = {}
    for r in S.whiten(frame, **how).collect():
        out.setdefault((r.row["vec_id"], int(r.deviation)), {})[r.component] = r
    return out


def same_as_brute(rows, out, k, tol=1e-9):
    kept, n, dev, a, w, v = brute(rows)
    assert sorted(out, key=repr) == sorted({(i, d) for (i, _), d in zip(kept, dev, strict=True)}, key=repr)
    sign = {}
    for (i, _), d, x in zip(kept, dev, a, strict=True):
        for c in range(1, k + 1):
            r, want = out[(i, d)][c], x @ v[c - 1] / np.sqrt(w[c - 1])
            if abs(want) > 1e-3:
                sign.setdefault(c, np.sign(r.whitened * want))
                assert abs(r.whitened * sign[c] - want) < tol * max(1, abs(want))
            assert abs(r.explained - w[c - 1] / w.sum()) < 1e-9 and r.identity_error < 1e-9 and r.n == n


def test_matches_eigenvectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 24) * np.linspace(2, 1, 24)]) for i in range(400)]
    rows += [(400, None), (401, [float("nan")] * 24), (402, [None] + [0.1] * 23), (403, [float("inf")] * 24), (None, [0.2] * 24), (7, rows[7][1])]
    out = got(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5))
    same_as_brute(rows, out, 8)


def test_nearby_eigenvalues(spark):
    """Noise without structure: neighbouring eigenvalues differ by a few per cent."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.12, 64)]) for i in range(2000)]
    same_as_brute(rows, got(spark.createDataFrame(rows, SCHEMA)), 8, 1e-8)


def test_few_dimensions_and_low_rank(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b), float(a), 1.0]) for i, (a, b) in enumerate(rng.integers(-3, 4, (50, 2)))]
    out = got(spark.createDataFrame(rows, SCHEMA))
    assert {len(r) for r in out.values()} == {2}  # only two directions have variance
    same_as_brute(rows, out, 2)


def test_equal_eigenvalues_are_all_found(spark):
    """The corners of a cross: every direction has the same variance, a Krylov space of one start has one dimension."""
    rows = [(2 * j + s, [float((2 * s - 1) * (j == d)) for d in range(6)]) for j in range(6) for s in range(2)]
    out = got(spark.createDataFrame(rows, SCHEMA))
    w = np.array([[r[c].whitened for c in range(1, 7)] for r in out.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(6)).max() < 1e-12
    assert all(abs(x.explained - 1 / 6) < 1e-12 for r in out.values() for x in r.values())


def test_early_end_is_proved():
    """Two strong directions in 40: the process ends before 40 steps, with the right result."""
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (300, 40)) * np.array([100, 50, *[1e-3] * 38])
    a -= a.mean(axis=0)
    s, v, norm, steps = S.bidiagonalise(lambda q: (a.T @ (a @ q), float((a * a).sum())), 40, 2)
    assert steps < 20
    u, want, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s, want[:2], rtol=1e-12) and np.allclose(np.abs(np.sum(v * right[:2], axis=1)), 1, atol=1e-12)


def test_empty_equal_and_single(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], SCHEMA)
    assert S.whiten(frame).collect() == [] and S.whiten(frame.limit(1)).collect() == [] and S.whiten(frame.limit(0)).collect() == []
    assert S.whiten(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).collect() == []


def test_different_lengths_and_huge_components(spark):
    rows = [(1, [1.0]), (2, [0.0, 1.0]), (3, [2.0, -1.0, 0.5]), (4, [])]
    same_as_brute(rows, got(spark.createDataFrame(rows, SCHEMA)), 2)
    huge = S.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 5.0])], SCHEMA)).collect()
    assert len(huge) >= 3 and all(np.isfinite(r.whitened) for r in huge)


@pytest.mark.parametrize("n", [7, 10**9])
def test_deviations_are_exact(n):
    rng = np.random.default_rng(4)
    y = rng.integers(-1000, 1000, (50, 16))
    sums = [int(s) * n + 3 for s in rng.integers(-100, 100, 16)]
    assert S.deviations(y, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in y]
