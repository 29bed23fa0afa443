import numpy as np
import pandas as pd
import pytest
from edge import clashing

from mkpulse.llm import topk_search as S
from mkpulse.llm.common import materialize


def brute(rows, k=20, scale=64):
    """Every row a candidate, every row of a fitting id a query of its own."""
    v = [(i, [int(min(max(np.floor(scale * float(x)), -(1 << 58)), 1 << 58)) for x in e]) for i, e in rows
         if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for at, (q, w) in enumerate(v):
        if q % 20 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(w, x)), -S.LONG), S.LONG), c) for n, (c, x) in enumerate(v) if n != at)[:k]
            out += [(q, r + 1, c, -score) for r, (score, c) in enumerate(s)]
    return sorted(out)


def run(frame, **how):
    v = materialize(S.quantized(frame), "topk-test")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in S.search(v, v.where("id % 20 = 0"), **how).collect())


@pytest.mark.parametrize("how", [{}, {"block": 7, "group_blocks": 3, "chunk": 4, "k": 5}])
def test_matches_brute_force(spark, how):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)]) for i in rng.permutation(400) - 50]
    rows += [(1000, [0.1] * 8), (1000, [0.1] * 8), (1020, None), (1040, [None] + [0.1] * 7), (1060, [float("nan")] * 8), (1080, [float("inf")] * 8),
             (None, [0.1] * 8), (1100, []), (1120, [0.5, 0.5]), (1140, [0.0] * 8), (1160, [0.0] * 8)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert run(frame, **how) == brute(rows, how.get("k", 20))


def test_ties_and_few_rows(spark):
    rows = [(i, [1.0, 1.0]) for i in range(0, 60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(frame, block=8, group_blocks=2, chunk=1) == brute(rows)
    few = [(0, [1.0]), (7, [2.0])]
    assert run(spark.createDataFrame(few, "vec_id long, embedding array<float>")) == brute(few)
    assert run(spark.createDataFrame(few, "vec_id long, embedding array<float>").limit(0)) == []


def test_large_weights_are_exact(spark):
    rows = [(i, [1e6 * (i % 7) + 1, 3e6 - i, 2.0**20]) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(frame, block=16) == brute(rows)


def test_rows_that_share_an_id_and_equal_rows(spark):
    rows = [(1, [5.0, 0.0]), (1, [0.1, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [64.0, 1.0]), (7, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = run(frame, block=2, group_blocks=1, chunk=1)
    assert got == brute(rows) and (40, 1, 1, 64 * 64 * 64 * 5) in got and sum(r[0] == 20 for r in got) == 2 * 5


def test_huge_components_saturate(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e300, -1e300, 3e18, 0.5] * 8)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=5, group_blocks=2, chunk=1) == brute(rows)


def clustered(seed, groups=32, each=64, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (groups, dim))
    centers *= 60 / np.linalg.norm(centers, axis=1, keepdims=True)
    return np.floor(np.concatenate([c + rng.normal(0, 1, (each, dim)) for c in centers])).astype("<i8")


def test_bounds_prune_blocks():
    """Vectors whose range follows their order: most blocks stay unread."""
    x = clustered(1)

    def block(rows, at):
        ids = np.arange(at, at + len(rows), dtype="<i8").tobytes()
        return {"n": len(rows), "dim": 16, "width": 8, "uids": ids, "ids": ids, "x": rows.tobytes(), "high": rows.max(0).tobytes(), "low": rows.min(0).tobytes()}

    group = pd.DataFrame([block(x[k : k + 64], k) for k in range(0, len(x), 64)])
    queries = pd.DataFrame([block(x[:20], 0)])
    want = x[:20] @ x.T
    lists = [sorted((-want[q, c], c) for c in range(len(x)) if c != q)[:20] for q in range(20)]
    for least in (None, {q: -lists[q][-1][0] for q in range(0, 20, 2)}):
        got, scored = S.top_of(queries, group, least=least)
        for q in range(20):
            assert got[got.query_id == q].sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist()[:20] == [c for _, c in lists[q]]
        assert scored < 0.5 * 20 * len(group)


def test_shuffled_vectors_are_ordered_and_pruned_before_they_are_sent(spark):
    """Ids carry no order: locality comes from the pivots. Few of the (query, block) pairs are scored, and few groups meet a chunk."""
    x = clustered(2)
    ids = np.random.default_rng(0).permutation(len(x))
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    v = materialize(S.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1), "topk-test")
    out, stats = S.search(v, v.where("id % 20 = 0"), block=32, group_blocks=4, chunk=16, stats=True)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == brute(rows, scale=1)
    s = stats.first()
    assert s.pairs == (len(x) // 20 + 1) * 64 and s.scored < 0.5 * s.pairs
