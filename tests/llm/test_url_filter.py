import random
import re

import pytest
from edge import clashing
from pyspark.sql import functions as F

from mkpulse.llm import url_filter as U
from mkpulse.llm.common import materialize

URLS = [None, "", "no scheme", "http://", "http://COM/", "https://Example.com/en/1?q=/fr/", "http://www.EXAMPLE.com/en/2#x", "http://a.www.example.com/en",
        "http://a.www.example.com/en/", "ftp://x.net/es/y", "http://net/fr/", "http://notnet/fr/", "http://x.net/de/", "http://example.com:80/en/",
        "http://a..com/", "http://.com/", "x://y://z.com/", "http://spam-farm.example.org/", "http://m.spam-farm.example.org?x", "http://example.com",
        "http://é.com/É", "http://" + "a." * 3000 + "com/" + "p" * 5000, "http://x.net/es/y"]


def brute(url, rules=U.RULES, hosts=U.BLOCKED_HOSTS):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate(str.maketrans(U.UPPER, U.LOWER)), m[2]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if any(("." + host).endswith("." + h) for h in hosts) else "allow"


def frames(spark):
    return U.rules_frame(spark, U.RULES), U.rules_frame(spark, [(h, "", "block") for h in U.BLOCKED_HOSTS])


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_edge_urls(spark, wrap):
    pages = wrap(spark.createDataFrame([(i if i else None, u) for i, u in enumerate(URLS)], "page_id long, url string"))
    got = U.judge(pages, *frames(spark)).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i if i else None, *brute(u)) for i, u in enumerate(URLS)], key=repr)


def test_cascade_is_exact_for_random_lists(spark):
    rng = random.Random(4)
    keys = [(f"k{i}", rng.random() < 0.2) for i in range(3000)]
    frame = spark.createDataFrame(keys, "key string, listed boolean").cache()
    c = U.Cascade.build(frame, "listed")
    assert len(c.levels) > 2  # there were false positives to encode
    assert frame.where(c.has(frame.key) != frame.listed).count() == 0


def test_a_list_of_a_million_keys(spark):
    keys = materialize(spark.range(1_020_000).select(F.concat(F.lit("h"), F.md5(F.col("id").cast("string")), F.lit(".com/")).alias("key"),
                                                     (F.col("id") >= 20_000).alias("listed")), "million-keys")
    c = U.Cascade.build(keys, "listed")
    assert max(level.bits for level in c.levels) < 2_000_000 and all(len(level.words) * 64 == level.bits for level in c.levels)
    assert keys.where(c.has(F.col("key")) != F.col("listed")).isEmpty()


def test_long_rule_list(spark):
    rng = random.Random(5)
    rules = [(f"h{rng.randrange(300)}.org", f"/{rng.randrange(9)}", rng.choice(["allow", "block"])) for _ in range(400)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(['', 'www.'])}h{rng.randrange(400)}.org/{rng.randrange(20)}" for _ in range(1000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), frames(spark)[1])
    assert {r.page_id: (r.rule, r.verdict) for r in got.select("row.page_id", "rule", "verdict").collect()} == {
        i: brute(u, rules)[2:] for i, u in enumerate(urls)}


def test_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = frames(spark)[0].limit(0)
    assert [(r.rule, r.verdict) for r in U.judge(pages, none, none).collect()] == [(None, "allow")]
    assert U.judge(pages.limit(0), *frames(spark)).count() == 0


def test_too_long_a_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 64)
    with pytest.raises(ValueError, match="bits"):
        U.Cascade.build(spark.createDataFrame([(f"k{i}", i % 2 == 0) for i in range(500)], "key string, listed boolean"), "listed")


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert not re.search("Python|Pandas|Arrow", U.judge(pages, *frames(spark))._jdf.queryExecution().executedPlan().toString())
