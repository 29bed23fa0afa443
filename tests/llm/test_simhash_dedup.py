import numpy as np
import pytest
import xxhash
from edge import CLEAN, clashing, documents

from mkpulse.llm import simhash_dedup as S


def brute_fp(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= bits:
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return [min((d for d in ids[root(i)] if d is not None), default=None) for i in range(len(rows))]


def test_fingerprints():
    for t in [None, "", " \n", "one", "One TWO", "a b c d e", CLEAN, "Été ſ A B c d e", "x " * 1000]:
        assert S.simhash(t) == brute_fp(t)


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_documents_match_brute_force(spark, wrap):
    docs = wrap(documents(spark))
    got = S.dedup(docs).collect()
    want = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    comp = brute_components(want, 2)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == sorted(
        [(d, f"{f:016x}", c) for (d, f), c in zip(want, comp)], key=repr)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_planted_distances(spark, bits):
    """Random fingerprints with planted neighbours, chains and one crowded cell."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for f in fps[:30]:
        g = f
        for _ in range(int(rng.integers(1, 4))):
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps += [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 64, 4) for b in range(1, 64, 4)]
    fps = list(dict.fromkeys(fps))
    rows = [(i, (f + 2**63) % 2**64 - 2**63) for i, f in enumerate(fps)]
    frame = spark.createDataFrame([((False, i, i), f) for i, f in rows], "who struct<none:boolean,id:long,uid:long>, fp long")
    got = {r.fp: r["first"].id for r in S.classes_with_components(frame, bits).collect()}
    want = brute_components([(i, f) for i, f in enumerate(fps)], bits)
    assert [got[f] for _, f in rows] == want


def test_crowded_cell_links_like_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, dtype=np.uint64)
    x = np.unique(np.array([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for a, b, c in
                                     rng.integers(0, 64, (300, 3))], dtype=np.uint64))
    for bits in (1, 2):
        links = S._links_in(x.view(np.int64), bits)
        assert len(x) > S.CROWDED and len(links) < len(x)
        comp = brute_components([(i, int(v)) for i, v in enumerate(x)], bits)
        at = {int(v): i for i, v in enumerate(x.view(np.int64))}
        up = list(range(len(x)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            assert (a ^ b).bit_count() <= bits or bin((a ^ b) & (2**64 - 1)).count("1") <= bits
            i, j = sorted((root(at[a]), root(at[b])))
            up[j] = i
        least = {}
        for i in range(len(x)):
            least.setdefault(root(i), i)
        assert [least[root(i)] for i in range(len(x))] == comp


def test_long_chain_is_one_component(spark):
    fps, f = [], 0
    for b in range(60):
        f ^= 1 << b
        fps.append(f)
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(fps, fps[1:])], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {f: min(fps) for f in fps if f != min(fps)}


def test_keep_first_keeps_one_of_each(spark):
    docs = clashing(documents(spark))
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    first = {}
    want = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    for (d, _), c in zip(want, brute_components(want, 2)):
        first.setdefault(c, c)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(first.values(), key=repr)


def test_empty_table(spark):
    assert S.dedup(documents(spark).limit(0)).count() == 0
    assert S.keep_first(documents(spark).limit(0)).count() == 0
