"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Its size is summed by source and leading hash
digits; the cumulative sums show the digit in which a source's budget ends.
Only that boundary bucket is read again, by the next digits, until it holds
one document. The digits found are a threshold: a document is in the mix when
its hash is below it. No document is sorted, thresholds of growing budgets
are nested, and a rerun finds the same thresholds.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; documents of size 0 contribute 0; equal rows are told apart by
their place in the input, so repeated rows can be taken in part; an empty
table gives an empty mix; other columns pass through ``mixed`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.llm.common import WORD, materialize, packed, text_of

#: Weights by the order of the sources (code point, null last), repeating.
WEIGHTS = (3, 1, 2)
#: Total of the mix as a share of all words, and the most copies of a source.
SHARE, MOST = 1.5, 2.0
#: Hash digits (hexadecimal) per level: 4096 buckets a source.
DIGITS = 3
HASH_LENGTH = 48


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``row``, ``source``, ``size`` (words) and ``hash``: md5 of id, source and text, then the row's place."""
    r = F.col("row")
    parts = [F.coalesce(F.concat(F.lit("="), r[c].cast("string")), F.lit("")) for c in (doc_id, source, text)]
    return packed(docs).select(
        "row", r[source].alias("source"),
        F.regexp_count(text_of(r[text]), F.lit(WORD)).cast("long").alias("size"),
        F.concat(F.md5(F.concat_ws("|", *parts)), F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")).alias("hash"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Budget shared by weight, no source above ``most`` times its size, excess
    reshared by weight: in order of size per weight, sources are full until
    the level of the rest fits. The windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    order = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sources.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), order % len(weights)).cast("double").alias("w"))
    w = w.withColumn("cap", most * F.col("source_size"))
    rising = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(rest))
    w = w.withColumn("at", F.row_number().over(rising))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))
    w = w.withColumn("level", F.min(fits).over(everything)["level"])
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to each source of ``plan``: ``copies`` that all its documents give, and
    ``below``: documents with a smaller hash (its first digits) give one more;
    ``with_last``: so does the last document, whose hash begins with ``below``.

    ``rows`` has source, size and hash.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select("*", whole.alias("copies"))
    plan = plan.select("*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("left"), F.lit("").alias("below"),
                       F.lit(False).alias("with_last"))
    plan = materialize(plan.withColumn("open", F.col("left") > 0), "mix-plan")
    for level in range(HASH_LENGTH // DIGITS):
        if plan.where("open").isEmpty():
            break
        at = plan.where("open").select(F.col("source").alias("s"), F.col("below").alias("prefix"))
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & F.col("hash").startswith(F.col("prefix")))
        sums = (inside.groupBy("source", F.substring("hash", 1 + DIGITS * level, DIGITS).alias("digits"))
                .agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        # at most 16^DIGITS buckets a source
        up_to = Window.partitionBy("source").orderBy("digits")
        sums = sums.withColumn("end", F.sum("size").over(up_to)).select(F.col("source").alias("s"), "digits", "size", "n", "end")
        hit = (plan.where("open").join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("end") >= F.col("left")))
               .groupBy("source").agg(F.min(F.struct("digits", "size", "n", "end")).alias("b")).select(F.col("source").alias("s"), "b"))
        plan = plan.join(hit, F.col("source").eqNullSafe(F.col("s")), "left")
        found, left = F.col("open") & F.col("b").isNotNull(), F.col("left") - (F.col("b.end") - F.col("b.size"))
        more = found & (F.col("b.n") > 1)
        plan = materialize(plan.select(
            "source", "source_size", "target", "copies",
            F.when(found, left).otherwise(F.col("left")).alias("left"),
            F.when(found, F.concat("below", F.col("b.digits"))).otherwise(F.col("below")).alias("below"),
            F.when(found, 2 * left > F.col("b.size")).otherwise(F.col("with_last")).alias("with_last"),
            F.coalesce(more, F.lit(False)).alias("open")), "mix-plan")
    return plan


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``rows`` (of ``sized``, materialized) with source_size, target and ``times`` each row is taken."""
    narrow = rows.select("source", "size", "hash")
    totals = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = thresholds(narrow, targets(totals, weights, share, most)).withColumnRenamed("source", "s")
    begins = F.expr("left(hash, length(below))")
    extra = F.when(F.col("below") == "", F.lit(False)).when(begins == F.col("below"), F.col("with_last")).otherwise(begins < F.col("below"))
    return (rows.join(plan.drop("left", "open"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("times", F.col("copies") + extra.cast("long")).drop("s", "copies", "below", "with_last"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **budget) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = mix(materialize(sized(docs, text, source, doc_id), "mix-rows"), **budget)
    return rows.where("times > 0").select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")
