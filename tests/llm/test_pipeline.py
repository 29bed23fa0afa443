"""Each stage of the corpus pipeline against the brute-force version of its operator."""

import sys
from collections import Counter
from pathlib import Path

import pytest
import test_mixing
import test_packing
import test_quality_rules
import test_secret_scan
import test_simhash_dedup
from edge import CLEAN, SCHEMA, clashing, documents, rows

sys.path.insert(0, str(Path(__file__).parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from mkpulse.llm import mixing  # noqa: E402
from mkpulse.llm.common import materialize  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def corpus(spark):
    more = [(100 + i, CLEAN.replace("quick", "slow", i % 3), "en", f"s{i % 4}", 7) for i in range(6)]
    more += [(200 + i, f'{CLEAN} w{i} token = "04dbebab91ab85687d33eeaaf9ac699e1188f9{i:02d}" ' + " ".join(f"z{i * k}" for k in range(90)), "en", "a", 1) for i in range(8)]
    return documents(spark).union(spark.createDataFrame(more, SCHEMA))


def test_stage_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "sequences"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_every_stage(spark, wrap):
    docs = materialize(wrap(corpus(spark)), "test")
    columns = docs.columns

    kept = materialize(STAGES["quality_rules"](spark, docs, ""), "test")
    assert kept.columns == columns
    # what no base rule rejects is clean text here and stays
    assert rows(kept.select("doc_id", "text")) == sorted(((r.doc_id, r.text) for r in docs.collect() if not test_quality_rules.brute(r.text)[-1]), key=repr)

    one = materialize(STAGES["simhash_dedup"](spark, kept, ""), "test")
    prints = [(r.doc_id, test_simhash_dedup.brute_fp(r.text)) for r in kept.collect()]
    assert one.columns == columns
    assert sorted((r.doc_id for r in one.collect()), key=repr) == sorted(set(test_simhash_dedup.brute_components(prints, 2)), key=repr)

    clean = materialize(STAGES["secret_scan"](spark, one, ""), "test")
    assert clean.columns == columns and clean.count() == one.count()
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        if not test_secret_scan.brute(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
        assert not test_secret_scan.brute(r.text) and ("[SECRET]" in r.text) == bool(test_secret_scan.brute(texts[r.doc_id]))

    mixed = materialize(STAGES["mixing"](spark, clean, ""), "test")
    plan = mixing.mix(materialize(mixing.sized(clean), "test")).collect()
    test_mixing.check(plan, clean.collect())
    assert mixed.columns == columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.row.doc_id: r.times for r in plan if r.times})

    test_packing.check(STAGES["packing"](spark, mixed, ""), mixed.collect())


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    got = out.collect()
    assert got and all(r.offset + r.length <= 1024 for r in got)


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "test")
        assert docs.count() == 0 and docs.columns == documents(spark).columns
    assert STAGES["packing"](spark, docs, "").count() == 0
