"""Sorts, top-k, set operations.

Global top-k compiles to ``TakeOrderedAndProject`` (each task keeps its own k
best, the driver merges k x tasks rows), so it never sorts the whole input.
Per-entity top-k uses ``row_number`` over a window partitioned by the entity.
Every ordering carries a unique tie-break so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.session import materialize
from mkpulse.functions import col

By = Sequence[str]
Order = Sequence[Column | str]


def _orders(order: Order) -> list[Column]:
    return [col(o) for o in order]


def top_k(df: DataFrame, order: Order, k: int, by: By = ()) -> DataFrame:
    """The k first rows by ``order`` (use ``F.desc(...)`` for
    descending), globally or per ``by`` entity."""
    if not by:
        return df.orderBy(*_orders(order)).limit(k)
    w = Window.partitionBy(*by).orderBy(*_orders(order))
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def rank_within(df: DataFrame, order: Order, by: By = (), name: str = "rank") -> DataFrame:
    """Row number by ``order`` (per entity). Without ``by`` use it only on a
    small, already aggregated frame."""
    w = Window.partitionBy(*by).orderBy(*_orders(order)) if by else Window.orderBy(*_orders(order))
    return df.withColumn(name, F.row_number().over(w))


def spread_rank(df: DataFrame, order: Order, by: By, name: str = "rank", kind: str = "int") -> DataFrame:
    """Row number by ``order`` in each entity, for entities of any size.

    The rows are dealt out by ranges of (entity, order) and written once; each
    range numbers its own rows and adds the rows of the entity in the ranges
    before it, so a large entity is numbered by many tasks."""
    ranges = df.repartitionByRange(*by, *_orders(order)).withColumn("_part", F.spark_partition_id())
    ranges = materialize(ranges, "ranked")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*_orders(order)))
    return ranges.join(sizes, same).withColumn(name, (own + F.col("_before")).cast(kind)).select(*df.columns, name)


def largest_smallest(df: DataFrame, score: str, key: str, k: int = 5, by: By = (), positive_smallest: bool = True):
    """The k largest and the k smallest rows by ``score``; the smallest
    list keeps only score > 0 AFTER taking k (as the reference does)."""
    big = top_k(df, [F.desc_nulls_last(score), F.asc(key)], k, by).withColumn("side", F.lit("largest"))
    small = top_k(df.where(F.col(score).isNotNull()), [F.asc(score), F.asc(key)], k, by)
    if positive_smallest:
        small = small.where(F.col(score) > 0)
    return big.unionByName(small.withColumn("side", F.lit("smallest")))


def top_n_others(df: DataFrame, label: str, metric: str, n: int = 8, by: By = (), sums: Sequence[str] = ()) -> DataFrame:
    """Keep the top ``n`` labels by ``metric``; collapse the rest into one
    'Others' row (other metrics 0) only when the remainder is > 0. Labels are
    unique (per entity); only the top ones are put in order."""
    top = top_k(df, [F.desc(metric), F.asc(label)], n, by)
    held = top.select(*[F.col(c).alias(f"_{c}") for c in (*by, label)])
    same = F.lit(True)
    for c in (*by, label):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rest = (
        df.join(held, same, "left_anti")
        .groupBy(*by)
        .agg(F.sum(metric).alias(metric))
        .where(F.col(metric) > 0)
        .withColumn(label, F.lit("Others"))
    )
    for s in sums:
        rest = rest.withColumn(s, F.lit(0).cast(dict(df.dtypes)[s]))
    return top.select(*by, label, metric, *sums).unionByName(rest.select(*by, label, metric, *sums))


def order_key(c: str | Column, values: Sequence[str]) -> Column:
    """Position of ``c`` in a fixed categorical order (unknown -> last)."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(col(c) == v, F.lit(i)).otherwise(out)
    return out


def latest_row(df: DataFrame, date_col: str, by: By = ()) -> DataFrame:
    """The newest row (per entity) - ``max_by`` over a struct, one pass."""
    others = [c for c in df.columns if c not in by]
    g = df.groupBy(*by).agg(F.max_by(F.struct(*others), F.col(date_col)).alias("_r"))
    return g.select(*by, "_r.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name (missing columns as NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples."""
    return df.select(*keys).dropDuplicates()


def needs_attention(scored: DataFrame, k: int = 3, score_max: float = 40.0, by: By = ()) -> DataFrame:
    """On N02 output, campaigns with cost above the 25th percentile
    (linear) and score below ``score_max``; the ``k`` lowest scores, tagged
    against N02's averages. The percentile is a window aggregate per entity
    over the already-limited scored set."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    s = scored.withColumn("_p25", F.percentile("cost", 0.25).over(w))
    # fixed values: issue tags
    tags = F.array_compact(
        F.array(
            F.when(F.col("conv_rate") < F.col("avg_conv_rate") * 0.5, F.lit("low conv rate")),
            F.when(F.col("cpa") > F.col("avg_cpa") * 1.5, F.lit("high CPA")),
            F.when(F.col("roas") < F.col("avg_roas") * 0.5, F.lit("low ROAS")),
        )
    )
    s = s.where((F.col("cost") > F.col("_p25")) & (F.col("efficiency_score") < score_max)).withColumn(
        "issues", F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise("underperforming")
    )
    s = top_k(s, [F.asc("efficiency_score"), F.asc("campaign_name")], k, by)
    return s.drop("_p25")
