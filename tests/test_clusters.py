from mkpulse.operators import scoring as N


def clustered(df, **how):
    return N.fit_keyword_clusters(df, **how).assign(df)


def test_keyword_clusters_separate_blobs(spark):
    rows = []
    for i in range(12):
        rows.append((f"a{i}", 10 + i % 3, 1000 + i, 0.01, 2.0))      # low clicks, low position
        rows.append((f"b{i}", 500 + i % 3, 1000 + i, 0.5, 9.0))      # high clicks
        rows.append((f"c{i}", 10 + i % 3, 90000 + i, 0.0001, 5.0))   # huge impressions
    df = spark.createDataFrame(rows, "keyword string, clicks long, impressions long, ctr double, position double")
    out = clustered(df, k=3).collect()
    assert len(out) == 36
    by_prefix = {}
    for r in out:
        by_prefix.setdefault(r.keyword[0], set()).add(r.cluster)
    assert all(len(v) == 1 for v in by_prefix.values())  # each blob in one cluster
    assert len({next(iter(v)) for v in by_prefix.values()}) == 3  # three distinct clusters
    s = {r.cluster: r.keywords for r in N.cluster_summary(clustered(df, k=3)).collect()}
    assert sorted(s.values()) == [12, 12, 12]


def test_keyword_clusters_needs_ten_rows(spark):
    df = spark.createDataFrame([(f"k{i}", i, 100, 0.1, 1.0) for i in range(5)],
                               "keyword string, clicks long, impressions long, ctr double, position double")
    out = clustered(df, k=3).collect()
    assert len(out) == 5 and all(r.cluster is None for r in out)


def test_all_keywords_are_assigned_beyond_the_fit(spark):
    rows = [(f"{'ab'[i % 2]}{i}", 10 if i % 2 else 500, 1000 + i, 0.01 if i % 2 else 0.5) for i in range(300)] + [("none", None, 5, 0.1)]
    df = spark.createDataFrame(rows, "keyword string, clicks long, impressions long, ctr double")  # paid: no position
    models = [N.fit_keyword_clusters(df, k=2, fit_rows=40).assign(df).collect() for _ in range(2)]
    assert {r.keyword: r.cluster for r in models[0]} == {r.keyword: r.cluster for r in models[1]}
    got = {r.keyword: r.cluster for r in models[0]}
    assert len(got) == 301 and got["none"] is None
    assert len({v for k, v in got.items() if k[0] == "a"}) == 1 == len({v for k, v in got.items() if k[0] == "b"})
    top = N.cluster_top_keywords(clustered(df, k=2)).collect()
    assert len(top) == 30


def test_best_of_ten_starts_wins_and_is_a_fixed_point():
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [tuple(map(float, r)) for r in rng.normal(0, 1, (120, 4)) * [5, 100, 0.1, 2] + rng.integers(0, 4, (120, 1)) * 8]
    names = [f"k{i}" for i in range(120)]
    one = [N.fit_entity(names, rows, 5, 1, 40)]
    best = N.fit_entity(names, rows, 5, 10, 40)
    x = np.array([[N._whole((v - m) / s) for v, m, s in zip(r, best.mean, best.std, strict=True)] for r in rows])

    def cost(fit):
        return int(((x[:, None, :] - np.array(fit.centers)[None]) ** 2).sum(axis=2).min(axis=1).sum())

    assert cost(best) <= cost(one[0])
    at = ((x[:, None, :] - np.array(best.centers)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [(x[at == j].sum(axis=0) // (at == j).sum()).tolist() for j in range(5)] == best.centers
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    for axis, want in zip(best.components, v[:, ::-1].T, strict=False):
        assert abs(abs(np.dot(axis, want)) - 1) < 1e-6  # the whole numbers' mean is zero but for rounding
    assert N.fit_entity(names[:9], rows[:9], 5, 10, 20) is None


def test_every_entity_found_has_a_fit(spark):
    rows = [(e, f"k{i}", i % 7 + 50 * (i % 2), 100 + i, 0.01 * i, 1.0 + i % 5) for e in ("tv", "watch", None) for i in range(20)] + [("car", "k", 1, 2, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "device string, keyword string, clicks long, impressions long, ctr double, position double")
    fitted = N.fit_keyword_clusters(df, k=2, by="device")
    assert set(fitted.fits) == {"tv", "watch", None}
    out = fitted.assign(df)
    assert out.where("device = 'car'").collect()[0].cluster is None and out.where("cluster IS NULL").count() == 1 and out.count() == 61
    alone = N.fit_keyword_clusters(df.where("device = 'tv'"), k=2).assign(df.where("device = 'tv'"))
    assert sorted(map(repr, out.where("device = 'tv'").collect())) == sorted(map(repr, alone.collect()))
    import pytest

    with pytest.raises(ValueError, match="more than 2"):
        N.fit_keyword_clusters(df, by="device", most=2)


def test_projection_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(f"k{i}", int(a), int(b) + 50, float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(
        rng.integers(0, 90, 60), rng.integers(0, 900, 60), rng.random(60), rng.random(60) * 9, strict=True))]
    df = spark.createDataFrame(rows, "keyword string, clicks long, impressions long, ctr double, position double")
    got = {r.keyword: (r.pca_x, r.pca_y) for r in N.fit_keyword_clusters(df).assign(df).collect()}
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    for axis in (0, 1):
        mine = np.array([got[r[0]][axis] for r in rows])
        assert np.abs(np.abs(mine) - np.abs(z @ v[axis])).max() < 1e-4
