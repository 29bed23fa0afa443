import re

import pytest
from edge import CLEAN, SCHEMA, clashing, documents, rows

from mkpulse.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {g: grams.count(g) for g in set(grams)} if len(grams) < 500 else {}
    if not count:
        for g in grams:
            count[g] = count.get(g, 0) + 1
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_measurements_match_brute_force(spark, wrap):
    docs = wrap(documents(spark))
    got = rows(Q.apply_policy(Q.ledger(docs)).select("doc_id", *MEASURES))
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)


def test_real_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows(Q.apply_policy(Q.ledger(docs)).select("doc_id", *MEASURES))
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)


def test_repeats(spark):
    texts = ["a b c a b c", "a b c d a b c", "a a a a", "a b c", "a b", "x y z " * 50, "a b c b a c b c a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in Q.ledger(docs).collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_policies_and_ablations(spark):
    texts = [CLEAN, "few words", CLEAN + " #" * 40, "\n".join(["a line that is here again and again"] * 40), None]
    led = Q.ledger(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).cache()
    kept = {p: {r.doc_id for r in Q.apply_policy(led, p).where("kept").collect()} for p in Q.POLICIES}
    assert kept["base"] == {0, 2} and kept["v1"] == {0} and kept["v2"] == {0}
    table = {(r.policy, r.rule): (r.n_failed, r.n_only) for r in Q.ablations(led).collect()}
    assert table["v1", None] == (4, 3) and table["v1", "symbols"] == (1, 1) and table["v1", "duplicate_lines"] == (1, 0)
    # without one rule a policy keeps exactly what that rule alone rejected
    for p in Q.POLICIES:
        for r in Q.RULES:
            if Q.POLICIES[p] & Q.BIT[r.name]:
                rest = Q.POLICIES[p] & ~Q.BIT[r.name]
                now = led.where(f"failed_bits & {rest} = 0").count() - led.where(f"failed_bits & {Q.POLICIES[p]} = 0").count()
                assert now == table[p, r.name][1]


def test_stored_ledger_serves_every_policy(spark, scratch):
    """Written once, by version of the rules; verdicts and ablations come from the stored bits, the texts are not there."""
    docs, path = documents(spark), f"{scratch}/ledger"
    for _ in range(2):  # storing again replaces the version
        Q.store(Q.ledger(docs), path)
    led = Q.stored(spark, path)
    assert led.count() == docs.count() and "text" not in led.columns and Q.stored(spark, path, Q.VERSION + 1).count() == 0
    got = Q.verdicts(led).collect()
    for r in got:
        assert [r[f"kept_{p}"] for p in Q.POLICIES] == [r.failed_bits & (m | Q.BASE) == 0 for m in Q.POLICIES.values()]
        alone = [x.name for x in Q.RULES if r.failed_bits & Q.POLICIES[Q.CURRENT] == Q.BIT[x.name]]
        assert r.sole_rule == (alone[0] if alone else None) and r.kept == r[f"kept_{Q.CURRENT}"]
        assert r.sole_rule_total == (sum(x.sole_rule == r.sole_rule for x in got) if alone else None)
    assert {r.sole_rule for r in got} > {None}


def test_keep_passes_rows_through(spark):
    docs = clashing(documents(spark))
    kept = Q.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 4, 6, 8, None], key=repr)


def test_empty_table(spark):
    assert Q.apply_policy(Q.ledger(documents(spark).limit(0))).count() == 0
    assert {r.n_failed for r in Q.ablations(Q.ledger(documents(spark).limit(0))).collect()} == {0}


def test_no_python_in_the_plan(spark):
    plan = Q.apply_policy(Q.ledger(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
