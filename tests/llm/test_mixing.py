import re

import pytest
from edge import clashing, documents

from mkpulse.llm import mixing as M
from mkpulse.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight, cut at the cap, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    cap, full, left = {s: most * n for s, n in sizes.items()}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(w[s] for s in rest)
        now = {s: left * w[s] / total for s in rest}
        over = [s for s in rest if now[s] > cap[s]]
        if not over:
            return {**{s: cap[s] for s in full}, **now}
        full |= set(over)
        left -= sum(cap[s] for s in over)


def check(got, docs):
    sizes, largest = {}, {}
    for r in docs:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
        largest[r.source] = max(n, largest.get(r.source, 0))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source], abs=1e-6) and r.source_size == sizes[r.source]
        assert r.times * r["size"] <= 2 * r["size"] and r.times in (0, 1, 2)
        taken[r.source] += r.times * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_edge_documents(spark, wrap):
    docs = wrap(documents(spark))
    rows = materialize(M.sized(docs), "t")
    got = M.mix(rows).collect()
    assert len(got) == docs.count()
    check(got, docs.collect())


def test_many_documents_refine_and_rerun(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = []
    for n in (1, 5):
        got = M.mix(materialize(M.sized(docs.repartition(n)), "t")).collect()
        check(got, docs.collect())
        runs.append({r.row.doc_id: r.times for r in got})
    assert runs[0] == runs[1]


def test_repeated_rows_are_taken_in_part(spark):
    docs = spark.createDataFrame([(1, "a b c", "hot")] * 600 + [(2, "x " * 3000, "other")], "doc_id long, text string, source string")
    check(M.mix(materialize(M.sized(docs), "t")).collect(), docs.collect())


def test_refines_within_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(M, "DIGITS", 1)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(900)], "doc_id long, text string, source string")
    check(M.mix(materialize(M.sized(docs), "t")).collect(), docs.collect())


def test_mixed_repeats_rows(spark):
    docs = clashing(documents(spark))
    times = sum(r.times for r in M.mix(materialize(M.sized(docs), "t")).collect())
    out = M.mixed(docs)
    assert out.columns == docs.columns and out.count() == times


def test_no_words_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.times * r["size"]) for r in M.mix(materialize(M.sized(docs), "t")).collect()] == [(0.0, 0)] * 2
    assert M.mixed(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.sized(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
