import hashlib

import numpy as np
import pytest
from edge import clashing

from mkpulse.llm import centroid_clustering as S

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, [int(np.floor(scale * float(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return sorted(out, key=repr), cents


def run(frame, **how):
    rows, model = S.cluster(frame, **how)
    return sorted(((r.id, r.cluster, int(r.distance)) for r in rows.collect()), key=repr), model


def blobs(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (6, dim))
    return [(i, [float(np.float32(x)) for x in centers[i % 6] + rng.normal(0, spread, dim)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_matches_brute_force(spark, spread):
    rows = blobs(600, 64, 0, spread)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [0.1] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] * 64), (904, [])]
    got, model = run(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(4))
    want, cents = brute(rows)
    assert got == want and model.centroids == cents
    assert model.total == sum(d for _, _, d in want) and sum(model.inertia.values()) == model.total
    if spread < 0.1:  # apart from the starts most gaps hold
        assert model.rescanned[0] == len(want) and model.rescanned[-1] < len(want)


def test_small_whole_numbers_tie_often(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) / 4 for x in rng.integers(-2, 3, 3)]) for i in range(300)]
    got, model = run(spark.createDataFrame(rows, SCHEMA), k=9, rounds=6, dim=3, scale=4)
    want, cents = brute(rows, 9, 6, 3, 4)
    assert got == want and model.centroids == cents


def test_equal_vectors_few_vectors_and_empty(spark):
    same = [(i, [0.25] * 4) for i in range(40)]
    assert run(spark.createDataFrame(same, SCHEMA), dim=4)[0] == brute(same, dim=4)[0]  # all ties: cluster 0, the others stay empty
    few = [(1, [0.5] * 4), (2, [-0.5] * 4)]
    assert run(spark.createDataFrame(few, SCHEMA), dim=4)[0] == brute(few, dim=4)[0]
    assert run(spark.createDataFrame(few[:1], SCHEMA), dim=4)[0] == [(1, 0, 0)]
    assert run(spark.createDataFrame(few, SCHEMA).limit(0), dim=4) == ([], S.Clustering([]))
    assert run(spark.createDataFrame(few, SCHEMA))[0] == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 * i), float(3 * i), 2.0**30]) for i in range(60)] + [(99, [2.0**50, 0.0, 0.0])]
    got, model = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, dim=3)
    assert (got, model.centroids) == brute(rows, 4, dim=3)
    run(spark.createDataFrame([(1, [3e38] * 3), (2, [-3e38] * 3)], SCHEMA), k=2, dim=3)


def test_heaps_hold_what_a_full_comparison_finds():
    """Many moves of one block: the heaps never miss a change, and pop few rows when centroids hardly move."""
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (2000, 8))
    cents = x[:12].copy()
    drift, state = np.zeros(12), (np.full(2000, -1, np.int32), np.array([]), np.array([], np.int32))
    seen = []
    for step in range(12):
        *state, n = S.advance(x, *state, cents, drift)
        seen.append(n)
        assert (state[0] == np.argmin(S.squared(x, cents), axis=1)).all()
        sizes = np.bincount(state[0], minlength=12)
        assert sorted(state[2].tolist()) == list(range(2000)) and (np.repeat(np.arange(12), sizes) == state[0][state[2]]).all()
        after = cents + rng.integers(-30 if step < 3 else -1, 31 if step < 3 else 2, cents.shape)
        drift, cents = drift + S.drifts(cents, after), after
    assert seen[0] == 2000 and all(n < 1200 for n in seen[5:])
