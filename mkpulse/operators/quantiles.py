"""Exact medians in two reads, without one task that holds all values.

The first read is one aggregate for all columns and entities at once: the
number of values and a mergeable quantile summary, which brackets the middle.
The second counts the values below the bracket and each value inside it (some
thousandth of all), again partially aggregated before the shuffle; the middle
ranks are looked up among those. The summary's error is a fifth of the
bracket; were the middle outside it nevertheless, the query would fail rather
than return a neighbour.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.operators.joins import attach_scalars

By = Sequence[str]

#: The summary's rank error is at most 1/ACCURACY of the values; the bracket reaches five times as far on either side.
ACCURACY = 10_000


def _attach(df: DataFrame, one: DataFrame, by: By) -> DataFrame:
    """The columns of the entity's row, or of the only row, which is computed once."""
    if by:
        return attach_scalars(df, one, by)
    row = one.select(F.struct(*one.columns).alias("_row")).scalar()
    return df.select("*", *[row[c].alias(c) for c in one.columns])


def medians(df: DataFrame, columns: Mapping[str, str], by: By = ()) -> DataFrame:
    """One row per entity: ``by`` and the median of each column of ``columns`` (NULLs left out) under the name it maps to.

    ``df`` is read twice, however many columns and entities there are.
    """
    by, around = list(by), [0.5 - 5 / ACCURACY, 0.5 + 5 / ACCURACY]

    def bracket(c: str) -> Column:
        return F.struct(F.count(c).alias("n"), F.percentile_approx(F.col(c).cast("double"), around, ACCURACY).alias("q"))

    bounds = df.groupBy(*by).agg(F.array(*[bracket(c) for c in columns]).alias("_bounds"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"), F.get("_bounds", F.lit(i)).alias("b"))
                     for i, c in enumerate(columns)])
    long = _attach(df.select(*by, *columns), bounds, by).select(*by, F.inline(each)).where(F.col("v") <= F.get("b.q", F.lit(1)))
    # every value below the bracket is the same to the count
    inside = F.when(F.col("v") >= F.get("b.q", F.lit(0)), F.col("v"))
    counts = long.groupBy(*by, "i", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.max("b.n").alias("_n"))
    counts = counts.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by, "i").orderBy(F.asc_nulls_first("_v"))))

    def at(i: int, rank: Column) -> Column:
        here = (F.col("i") == i) & (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))
        failed = F.raise_error(F.lit("the quantile summary missed the median")).cast("double")
        return F.max(F.when(here, F.coalesce("_v", failed)))

    def middle(i: int) -> Column:
        low, high = (at(i, F.floor(r)) for r in ((F.col("_n") - 1) / 2, F.col("_n") / 2))
        failed = F.raise_error(F.lit("the quantile summary missed the median")).cast("double")
        there = F.count(F.when(F.col("i") == i, 1)) > 0
        return F.when(there, F.coalesce((low + high) / 2, failed))

    return counts.groupBy(*by).agg(*[middle(i).alias(name) for i, name in enumerate(columns.values())])


def with_medians(df: DataFrame, columns: Mapping[str, str], by: By = (), of: Column | None = None) -> DataFrame:
    """``df`` with the medians of its entity (of its rows where ``of`` holds) on every row."""
    return _attach(df, medians(df if of is None else df.where(of), columns, by), by)
