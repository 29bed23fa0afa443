import functools
import hashlib
import os
import random

import numpy as np
import pytest
from edge import LONG, clashing, documents

from mkpulse.llm import suffix_dedup as S


def brute(texts, length):
    count = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **how):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(frame, **how).collect())
    return [g[1:] for g in got]


def corpus(seed, n=40):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abc é") for _ in range(rng.randint(15, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        out.append("".join(parts)[: rng.randint(0, 400)])
    return out + ["", "a" * 300, "ab" * 150, out[0], out[1] + "x"]


@pytest.mark.parametrize("seed, length, gram, hot", [(1, 40, 12, 10**6), (2, 30, 8, 10**6), (3, 40, 12, 3), (4, 25, 25, 10**6), (5, 40, 12, 0)])
def test_matches_brute_force(spark, monkeypatch, seed, length, gram, hot):
    monkeypatch.setattr(S, "RUN", 17)
    texts = corpus(seed)
    assert run(spark, texts, length=length, gram=gram, hot=hot) == brute([t.encode() for t in texts], length)


def test_runs_are_flushed_inside_a_long_text(spark, monkeypatch):
    """A text with far more anchors than a run holds, and its copies: several runs come from one row."""
    monkeypatch.setattr(S, "coverage", functools.partial(S.coverage, run_entries=20))
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    texts = [long, long[5_000:9_000] + "x" * 100 + long[100:300], "".join(rng.choice("abcdefgh ") for _ in range(3_000))]
    assert run(spark, texts, length=60, gram=16) == brute([t.encode() for t in texts], 60)


def test_nothing_is_left_behind_but_what_the_result_reads(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = S.dedup(spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3))], "doc_id long, text string"), length=40, gram=12)
    out.collect()
    assert sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before) == ["repeated-spans", "suffix-input"]


def test_production_length(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij klmno") for _ in range(260))
    texts = ["".join(rng.choice("abcdefghij klmno") for _ in range(rng.randint(0, 900))) + (passage[rng.randint(0, 80) :] if k % 2 else "")
             + "".join(rng.choice("abcdefghij klmno") for _ in range(rng.randint(0, 500))) for k in range(60)]
    assert run(spark, texts) == brute([t.encode() for t in texts], 200)


def test_every_window_has_an_anchor_chosen_by_content():
    rng = np.random.default_rng(3)
    a = bytes(rng.integers(97, 100, 700, dtype=np.uint8))
    b = bytes(rng.integers(97, 100, 333, dtype=np.uint8)) + a[100:600] + bytes(rng.integers(97, 100, 50, dtype=np.uint8))
    i, at, _ = S.anchors_of([a, b, b"short"], 60, 20)
    first, second = set(at[i == 0].tolist()), set(at[i == 1].tolist())
    for s in range(len(a) - 59):
        assert any(s <= p <= s + 40 for p in first)
    shared = [p for p in first if 140 <= p <= 540]
    assert shared and all(p + 233 in second for p in shared)


def test_slices_of_long_texts(monkeypatch):
    rng = np.random.default_rng(4)
    t = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    whole = S.anchors_of([t], 60, 20)
    monkeypatch.setattr(S, "SLICE", 700)
    cut = S.anchors_of([t, b"x" * 61], 60, 20)
    assert set(whole[1].tolist()) == set(cut[1][cut[0] == 0].tolist()) and len(set(cut[1][cut[0] == 0].tolist())) == (cut[0] == 0).sum()


def test_runs_are_front_coded_and_merged_without_comparing_known_prefixes():
    rng = random.Random(6)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(600)]
    entries = [(k, b"left" + k[:2], n, n + 1, 1) for n, k in enumerate(keys)]
    runs = [sorted(entries[k::7]) for k in range(7)] + [[]]
    data = [S.encode_run(r) for r in runs]
    assert [[e for _, e in S.decode_run(d)] for d in data] == runs
    tree = S.LoserTree([S.decode_run(d) for d in data])
    got = list(tree.pops())
    assert [e[0] for _, e in got] == sorted(keys)
    for (_, (a, *_)), (n, (b, *_)) in zip(got, got[1:]):
        assert n == len(__import__("os").path.commonprefix([a, b]))
    assert tree.compared < 600 * 3  # far fewer than log2(8) plays of every entry
    assert list(S.LoserTree([]).pops()) == []


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_edge_documents(spark, wrap):
    docs = wrap(documents(spark))
    got = S.dedup(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.row.doc_id: r for r in got}
    assert by_id[6].n_removed == 0 and by_id[6].n_bytes == len(LONG)
    assert by_id[1].n_removed == by_id[1].n_bytes == by_id[4].n_removed and by_id[1].n_spans == 1
    assert by_id[9].n_removed == 0 and by_id[2].n_bytes == 0


def test_empty_table(spark):
    assert S.dedup(documents(spark).limit(0)).count() == 0
