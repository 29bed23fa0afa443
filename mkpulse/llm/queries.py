"""The registered queries of the corpus operators: whole tables, production parameters.

Each one applies its operator and derives the contract's columns from what the
operator returns. ``ORACLE`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mkpulse.llm import (
    centroid_clustering,
    html_extract,
    license_scan,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    simhash_dedup,
    suffix_dedup,
    topk_search,
    url_filter,
    warc_zstd,
    whitening,
)
from mkpulse.llm.common import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


#: Measurements of every document in DuckDB; also the first stage of the pipeline's SQL.
QUALITY_CTE = r"""
src AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
wrd AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM src),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM wrd)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
lin AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM
        (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM src)
        WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
mea AS (SELECT wrd.rid, doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
          CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
          CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          coalesce(lin.n_dup, 0) AS n_dup_lines, coalesce(lin.n_lines, 0) AS n_lines,
          coalesce(cov.n, 0) AS n_repeat_words,
          coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
          length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_capitals
        FROM wrd LEFT JOIN lin USING (rid) LEFT JOIN cov USING (rid)),
led AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
          OR word_chars > 15 * n_words OR longest_word > 1000 OR 100 * n_capitals > 60 * word_chars AS more_failed
        FROM mea)
"""


def _ledger_sql() -> str:
    rules, names = quality_rules.RULES, quality_rules.POLICIES
    bits = " | ".join(f"CASE WHEN {r.sql} THEN {quality_rules.BIT[r.name]} ELSE 0 END" for r in rules)
    current = names[quality_rules.CURRENT]
    kept = ", ".join(f"failed_bits & {m | quality_rules.BASE} = 0 AS kept_{p}" for p, m in names.items())
    sole = " ".join(f"WHEN {quality_rules.BIT[r.name]} THEN '{r.name}'" for r in rules)
    return f"""WITH {QUALITY_CTE},
bit AS (SELECT *, {bits} AS failed_bits FROM mea),
one AS (SELECT *, CASE failed_bits & {current} {sole} END AS sole_rule FROM bit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {quality_rules.BASE} <> 0 AS base_failed,
       failed_bits & {current | quality_rules.BASE} = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits, {kept}, sole_rule,
       CASE WHEN sole_rule IS NOT NULL THEN COUNT(*) OVER (PARTITION BY sole_rule) END AS sole_rule_total FROM one"""


@query("op6_quality_ledger", _ledger_sql())
def op6(spark, sf_dir):
    led = materialize(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality-ledger")
    return quality_rules.verdicts(led).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                              "failed_bits", *[f"kept_{p}" for p in quality_rules.POLICIES], "sole_rule", "sole_rule_total")


@query("op4_mix_sources", r"""WITH src AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce('=' || doc_id, ''), coalesce('=' || source, ''), coalesce('=' || text, ''))) AS h
  FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM src GROUP BY source),
wts AS (SELECT source, s, CAST([3, 1, 2][1 + k % 3] AS DOUBLE) AS w, 2.0 * s AS cap FROM tot),
lev AS (SELECT *, row_number() OVER o AS pos,
          (1.5 * sum(s) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM wts WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
one AS (SELECT arg_min(level, pos) AS level FROM lev WHERE level * w <= cap),
tgt AS (SELECT source, s, least(cap, coalesce((SELECT level FROM one) * w, cap)) AS target FROM lev),
cop AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS copies FROM tgt),
run AS (SELECT src.doc_id, src.size, cop.s, cop.target, copies, target - copies * cop.s AS rest,
          sum(size) OVER (PARTITION BY src.source ORDER BY h, doc_id) AS upto
        FROM src JOIN cop ON src.source IS NOT DISTINCT FROM cop.source)
SELECT doc_id, size, s AS source_size, target,
       size * (copies + CASE WHEN rest > 0 AND (upto < rest OR (upto - size < rest AND 2 * (rest - (upto - size)) > size))
               THEN 1 ELSE 0 END) AS taken FROM run""")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.sized(docs).select(F.col("row.doc_id").alias("doc_id"), "source", "size", "hash")
    out = mixing.mix(materialize(rows, "mix-rows"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op7_simhash_components")
def op7(spark, sf_dir):
    return simhash_dedup.dedup(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op1_pack_best_fit")
def op1(spark, sf_dir):
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_secret_spans")
def op8(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"] != secret_scan.MODEL_KIND)
    return found.select(F.col("row.doc_id").alias("doc_id"), *map(number, secret_scan.KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
_HOSTS_SQL = ", ".join(f"'{h}'" for h in url_filter.BLOCKED_HOSTS)


@query("op10_url_cascade", f"""WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
cut AS (SELECT row_number() OVER () AS rid, page_id,
          CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
par AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT rid, arg_max(struct_pack(r := rh || rp, v := rv), length(rh || rp)) AS best FROM par JOIN rules
        ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, best.r AS rule,
       coalesce(best.v, CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{_HOSTS_SQL}]) AS b) WHERE host = b OR ends_with(host, '.' || b))
                        THEN 'block' ELSE 'allow' END) AS verdict
FROM par LEFT JOIN fit USING (rid)""")
def op10(spark, sf_dir):
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    hosts = url_filter.rules_frame(spark, [(h, "", "block") for h in url_filter.BLOCKED_HOSTS])
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, hosts)
    return out.select("row.page_id", "host", "path", "rule", "verdict")


@query("op5_warc_zstd_dictionary", """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d),
c AS (SELECT *, list_transform(range(32), lambda k: 1 + (CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) % 32) AS five FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to FROM c""")
def op5(spark, sf_dir):
    archives = warc_zstd.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return warc_zstd.read_archives(archives).drop("url", "payload")


@query("op2_main_text")
def op2(spark, sf_dir):
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_topk_blocks", """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op3(spark, sf_dir):
    vectors = materialize(topk_search.quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64), "topk-vectors")
    return topk_search.search(vectors, vectors.where(F.col("id") % 20 == 0), k=20).drop("uid")


@query("op9_suffix_merge")
def op9(spark, sf_dir):
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_whiten_lanczos")
def op11(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, scale=1024)
    # a deviation beyond a long (over some 10^9 rows squared) is null
    return out.select("row.vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")


def _license_sql() -> str:
    t = license_scan.TEMPLATES
    text = ", ".join(f"({n}, '{x.label}', string_split('{x.text}', ' '))" for n, x in enumerate(t))
    keys = ", ".join(f"({n}, {license_scan.places(x.text.split(), k.split())[0]}, string_split('{k}', ' '))" for n, x in enumerate(t) for k in x.keys)
    base = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in license_scan.PHRASES.items())
    return rf"""WITH tpl(t, label, w) AS (VALUES {text}), kys(t, pl, w) AS (VALUES {keys}), phr(label, w) AS (VALUES {base}),
src AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
          '{license_scan.WORD}') AS w FROM documents),
wrd AS (SELECT rid, w[i + 1] AS x, i FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM src)),
tpw AS (SELECT t, w[i + 1] AS x, i AS pl FROM (SELECT t, w, unnest(range(len(w))) AS i FROM tpl)),
cnt AS (SELECT x, count(DISTINCT rid) AS n FROM wrd WHERE x IN (SELECT x FROM tpw) GROUP BY x),
rar AS (SELECT t, x FROM (SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), x) AS k
          FROM (SELECT DISTINCT t, x FROM tpw) LEFT JOIN cnt USING (x)) WHERE k <= {license_scan.RARE}),
pos AS (SELECT t, x, pl, count(*) OVER (PARTITION BY t) AS everything FROM tpw JOIN rar USING (t, x)),
can AS (SELECT rid, t, i - pl AS o, count(*) AS n, max(everything) AS everything FROM wrd JOIN pos USING (x) GROUP BY rid, t, o HAVING 2 * n >= max(everything)),
see AS (SELECT can.rid, can.t, o, n, everything, kys.pl, bool_or(o + kys.pl + d >= 0 AND src.w[o + kys.pl + d + 1 : o + kys.pl + d + len(kys.w)] = kys.w) AS ok
        FROM can JOIN kys USING (t) JOIN src USING (rid), (SELECT unnest(range(-{license_scan.SLACK}, {license_scan.SLACK + 1})) AS d)
        GROUP BY can.rid, can.t, o, n, everything, kys.pl, kys.w),
own AS (SELECT rid, label, n / everything AS share FROM (SELECT rid, t, o, any_value(n) AS n, any_value(everything) AS everything FROM see
          GROUP BY rid, t, o HAVING bool_and(ok)) JOIN tpl USING (t)),
bas AS (SELECT rid, phr.label, i FROM wrd JOIN phr ON x = phr.w[1] JOIN src USING (rid) WHERE src.w[i + 1 : i + len(phr.w)] = phr.w),
bsm AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM bas GROUP BY rid),
alb AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT rid, label FROM bas UNION ALL SELECT rid, label FROM own) GROUP BY rid),
scr AS (SELECT rid, max(share) AS score FROM own GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(bsm.l, '') AS base_labels,
       coalesce(alb.l, '') AS labels, coalesce(score, 0.0) AS score
FROM src LEFT JOIN bsm USING (rid) LEFT JOIN alb USING (rid) LEFT JOIN scr USING (rid)"""


@query("op12_license_index", _license_sql())
def op12(spark, sf_dir):
    found = license_scan.verdicts(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _clustering_sql(k: int, rounds: int, dim: int, scale: int) -> str:
    def near(r: int) -> str:
        return f"""a{r} AS (SELECT rid, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT v.rid, m.c,
          CAST(list_inner_product(v.f, v.f) - 2 * list_inner_product(v.f, m.f) + list_inner_product(m.f, m.f) AS BIGINT) AS d
        FROM v, (SELECT c, e, CAST(e AS DOUBLE[]) AS f FROM c{r}) m) GROUP BY rid)"""

    def move(r: int) -> str:
        return f"""s{r} AS (SELECT c, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT a{r}.c, v.e, unnest(range(1, {dim + 1})) AS i FROM v JOIN a{r} USING (rid)) GROUP BY c, i),
c{r + 1} AS (SELECT c{r}.c, coalesce(g.e, c{r}.e) AS e FROM c{r} LEFT JOIN
        (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c) g USING (c))"""

    steps = ", ".join(f"{near(r)}, {move(r)}" for r in range(rounds))
    return f"""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER () AS rid, vec_id, e, CAST(e AS DOUBLE[]) AS f FROM q),
c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v) ORDER BY h, e LIMIT {k}),
{steps},
{near(rounds)},
g AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, own AS cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia,
       sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN g USING (c) JOIN c{rounds} m USING (c)"""


@query("op13_heap_kmeans", _clustering_sql(16, 3, 64, 64))
def op13(spark, sf_dir):
    rows, model = centroid_clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=16, rounds=3, dim=64, scale=64)
    fits = {a: s if s is not None and s < 2**63 else None for a, s in model.inertia.items()}
    total = model.total if model.total is not None and model.total < 2**63 else None
    sha = {a: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for a, c in enumerate(model.centroids)}
    return rows.select(F.col("id").alias("vec_id"), "cluster", F.expr("try_cast(distance AS BIGINT)").alias("distance"),
                       centroid_clustering.by_cluster(fits, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"),
                       centroid_clustering.by_cluster(sha, "string").alias("centroid_sha256"))
