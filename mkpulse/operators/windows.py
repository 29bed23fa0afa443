"""Window and time-series operators.

Windows are partitioned by the caller's ``by`` entities. With ``by=()`` they
run unpartitioned, which is only done on frames already aggregated to one row
per day (or per ranked item): the input of those windows is bounded by the
number of days, not by the number of fact rows. On raw grains (hours, single events)
give ``spread``: the series is cut into ranges of so many rows, each of which
borrows the rows before it that its windows reach (a halo), so that a series
of any length is rolled over by many tasks. Rolling logic is row based
(``rowsBetween``), like the reference; gaps are not densified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mkpulse.functions import col, div, pct_change_abs
from mkpulse.operators.joins import attach_scalars
from mkpulse.operators.topk import spread_rank, top_k

By = Sequence[str]


def _w(by: By) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy()


def keep_latest(df: DataFrame, keys: Sequence[str], order_col: str = "extracted_at", tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per key, newest ``order_col`` first (NULLs
    last), ``tiebreak`` columns (descending) decide equal times.

    Written as ``max_by`` over a struct instead of ``row_number``: the choice
    is partially aggregated before the shuffle, so a hot key (one key holding
    a large share of the rows) never has to be sorted inside one task.
    NULL sorts lowest inside a struct, which gives "NULLs last" for free.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in [order_col, *tiebreak]])
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def with_halo(df: DataFrame, order: Sequence[str], n: int, by: By = (), size: int = 1_000_000) -> DataFrame:
    """``df`` for windows of ``n`` rows that end at each row, as ranges of ``size`` consecutive rows of an entity.

    ``_range`` numbers the range, ``_at`` the row in the entity (from 0).
    Every range also holds the ``n`` - 1 rows before its own, marked
    ``_halo``. A window partitioned by (``by``, ``_range``) and ordered by
    ``_at`` then sees what one over the whole entity would; drop the marked
    rows afterwards."""
    ranked = spread_rank(df, [F.asc(c) for c in order], by, "_at", "bigint").withColumn("_at", F.col("_at") - 1)
    first, last = (F.floor(x / size) for x in (F.col("_at"), F.col("_at") + (n - 1)))
    dealt = ranked.withColumn("_range", F.explode(F.sequence(first, last)))
    return dealt.withColumn("_halo", F.col("_range") != F.floor(F.col("_at") / size))


def _series(df: DataFrame, date_col: str | Sequence[str], n: int, by: By, spread: int | None):
    """The frame, its window specification without a frame, and what turns the result back."""
    order = [date_col] if isinstance(date_col, str) else list(date_col)
    if spread is None:
        return df, Window.partitionBy(*by).orderBy(*order), lambda out: out
    cut = with_halo(df, order, n, by, spread)
    return cut, Window.partitionBy(*by, "_range").orderBy("_at"), lambda out: out.where(~F.col("_halo")).drop("_at", "_range", "_halo")


def rolling_anomalies(
    daily: DataFrame,
    value: str,
    date_col: str | Sequence[str] = "date_day",
    by: By = (),
    threshold: float = 2.5,
    window: int = 7,
    min_periods: int = 3,
    min_rows: int = 7,
    include_current: bool = True,
    spread: int | None = None,
) -> DataFrame:
    """Rolling mean / sample std over ``window`` rows (the current row
    included, as in the reference; ``include_current=False`` uses the previous
    rows only), z-score, spike / drop / normal, deviation %. Entities with
    fewer than ``min_rows`` rows produce no rows. ``spread``: see above."""
    hi = 0 if include_current else -1
    cut, o, back = _series(daily, date_col, window - hi, by, spread)
    r = o.rowsBetween(-(window - 1) + hi, hi)
    v = F.col(value)
    n = F.count(v).over(r)
    if spread is None:
        counted = cut.withColumn("_n", F.count(F.lit(1)).over(_w(by)))
    else:
        counted = attach_scalars(cut, daily.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    df = (
        counted.where(F.col("_n") >= min_rows)
        .withColumn("rolling_mean", F.when(n >= min_periods, F.avg(v).over(r)))
        .withColumn("rolling_std", F.when(n >= min_periods, F.stddev_samp(v).over(r)))
        .withColumn("z_score", div(v - F.col("rolling_mean"), "rolling_std"))
    )
    z = F.col("z_score")
    t = float(threshold)
    return back(
        df.withColumn("anomaly_type", F.when(z > t, "spike").when(z < -t, "drop").otherwise("normal"))
        .withColumn("is_anomaly", F.coalesce(F.abs(z) > t, F.lit(False)))
        .withColumn("deviation_pct", div(v - F.col("rolling_mean"), "rolling_mean") * 100)
        .drop("_n")
    )


def moving_average(df: DataFrame, value: str, date_col: str | Sequence[str] = "date_day", n: int = 7, by: By = (), name: str = "ma",
                   spread: int | None = None) -> DataFrame:
    """N-row moving average, NULL until n rows are available. ``spread``: see above."""
    cut, o, back = _series(df, date_col, n, by, spread)
    r = o.rowsBetween(-(n - 1), 0)
    return back(cut.withColumn(name, F.when(F.count(F.lit(1)).over(r) == n, F.avg(value).over(r))))


def last_vs_previous(daily: DataFrame, values: Sequence[str], date_col: str = "date_day", by: By = ()) -> DataFrame:
    """The last row per entity with the previous row's values (``prev_*``)
    and the relative change ``(last - prev) / prev`` (NULL unless prev > 0).
    Entities with fewer than 2 rows give no row."""
    o = Window.partitionBy(*by).orderBy(date_col)
    df = daily
    for v in values:
        df = df.withColumn(f"prev_{v}", F.lag(v).over(o))
    df = df.withColumn("_rd", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(date_col).desc())))
    df = df.withColumn("_n", F.count(F.lit(1)).over(_w(by)))
    out = df.where((F.col("_rd") == 1) & (F.col("_n") >= 2)).drop("_rd", "_n")
    for v in values:
        p = F.col(f"prev_{v}")
        out = out.withColumn(f"{v}_change", F.when(p > 0, (F.col(v) - p) / p))
    return out


def first_last_window(daily: DataFrame, value: str, date_col: str = "date_day", k: int = 7, by: By = (), disjoint: bool = False) -> DataFrame:
    """Sum of the first ``k`` rows (``last_week``) vs the last ``k`` rows
    (``this_week``). Needs >= k rows. With fewer than 2k rows the two windows
    overlap, as in the reference; ``disjoint=True`` requires 2k rows."""
    asc = F.row_number().over(Window.partitionBy(*by).orderBy(date_col))
    desc = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(date_col).desc()))
    df = daily.withColumn("_ra", asc).withColumn("_rd", desc)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.when(F.col("_rd") <= k, F.col(value))).alias("this_week"),
        F.sum(F.when(F.col("_ra") <= k, F.col(value))).alias("last_week"),
    )
    g = g.where(F.col("days") >= (2 * k if disjoint else k))
    return g.withColumn("week_change", F.when(F.col("last_week") > 0, (F.col("this_week") - F.col("last_week")) / F.col("last_week")))


def half_split(daily: DataFrame, values: Sequence[str], date_col: str = "date_day", by: By = ()) -> DataFrame:
    """Mean of each value over the first floor(n/2) rows by date vs
    the remaining rows, with F04b %-change (``<v>_change``)."""
    o = Window.partitionBy(*by).orderBy(date_col)
    df = daily.withColumn("_rn", F.row_number().over(o)).withColumn("_n", F.count(F.lit(1)).over(_w(by)))
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    aggs = [F.first("_n").alias("n_rows")]
    for v in values:
        aggs += [F.avg(F.when(first, F.col(v))).alias(f"first_{v}"), F.avg(F.when(~first, F.col(v))).alias(f"second_{v}")]
    g = df.groupBy(*by).agg(*aggs)
    for v in values:
        g = g.withColumn(f"{v}_change", pct_change_abs(f"second_{v}", f"first_{v}"))
    return g


def max_normalize(df: DataFrame, cols: Sequence[str], by: By = ()) -> DataFrame:
    """Each column / its max x 100 (left unchanged when the max is <= 0)."""
    for c in cols:
        m = F.max(c).over(_w(by))
        df = df.withColumn(f"{c}_norm", F.when(m > 0, F.col(c) / m * 100).otherwise(F.col(c).cast("double")))
    return df


def minmax_normalize(df: DataFrame, c: str, by: By = (), name: str | None = None) -> DataFrame:
    """(x - min) / (max - min) x 100; NULL for a constant series."""
    lo, hi = F.min(c).over(_w(by)), F.max(c).over(_w(by))
    return df.withColumn(name or f"{c}_norm", div(F.col(c) - lo, hi - lo) * 100)


def funnel_steps(steps: DataFrame, by: By = ()) -> DataFrame:
    """Step-to-step conversion and drop-off % (0 when the previous step
    has no users) over rows (step, name, users)."""
    o = Window.partitionBy(*by).orderBy("step")
    prev = F.lag("users").over(o)
    df = steps.withColumn("_prev", prev)
    conv = F.when(F.col("_prev").isNull(), F.lit(None)).when(F.col("_prev") > 0, F.col("users") / F.col("_prev") * 100).otherwise(0.0)
    df = df.withColumn("conversion_rate", conv.cast("double"))
    drop = F.when(F.col("_prev").isNull(), F.lit(None)).when(F.col("_prev") > 0, 100 - F.col("conversion_rate")).otherwise(0.0)
    return df.withColumn("dropoff_rate", drop.cast("double")).drop("_prev")


def biggest_dropoff(funnel: DataFrame, by: By = ()) -> DataFrame:
    """The step with the largest drop-off (first step on ties) and its
    severity: > 70 critical, > 50 high, else none."""
    f = funnel.where(F.col("dropoff_rate").isNotNull())
    g = f.groupBy(*by).agg(
        F.max_by(F.struct("name", "dropoff_rate"), F.struct(F.col("dropoff_rate"), -F.col("step"))).alias("_b")
    )
    d = F.col("_b.dropoff_rate")
    return g.select(
        *by,
        F.col("_b.name").alias("step_name"),
        d.alias("dropoff_rate"),
        F.when(d > 70, "critical").when(d > 50, "high").otherwise("none").alias("severity"),
    )


def share_of_total(df: DataFrame, c: str, by: By = (), name: str | None = None) -> DataFrame:
    """Value x 100 / entity total."""
    return df.withColumn(name or f"{c}_share", div(F.col(c) * 100, F.sum(c).over(_w(by))))


def linear_forecast(
    daily: DataFrame, value: str, date_col: str = "date_day", horizon: int = 14, by: By = (), fit_rows: int = 14, min_rows: int = 14
) -> DataFrame:
    """Forecast ``horizon`` days after the last date.

    value_i = max(0, MA7(last) + slope x i), i = 1..horizon; slope is the OLS
    slope over the last ``fit_rows`` rows against their position (0 when fewer
    than 7 non-null values); CI = +-1.96 x sample std of the whole series, lower
    bound floored at 0. Only entities with >= ``min_rows`` rows. One aggregate
    over the series and one over its last rows, then ``sequence`` + ``explode``
    of ``horizon`` rows; no window spans a series.
    """
    # what looks back reads the last rows alone, which are limited per entity before any exchange
    last = top_k(daily, [F.desc(date_col)], max(fit_rows, 7), by)
    od = Window.partitionBy(*by).orderBy(F.col(date_col).desc())
    tail = moving_average(last.withColumn("_rd", F.row_number().over(od)), value, date_col, 7, by, name="_ma7")
    x = (F.lit(fit_rows) - F.col("_rd")).cast("double")  # 0..fit_rows-1 on the fitted tail
    in_fit = F.col("_rd") <= fit_rows
    ends = tail.groupBy(*by).agg(
        F.max(F.when(F.col("_rd") == 1, F.col("_ma7"))).alias("ma7_last"),
        F.regr_slope(F.when(in_fit, F.col(value)), F.when(in_fit & F.col(value).isNotNull(), x)).alias("_slope"),
        F.count(F.when(in_fit, F.col(value))).alias("_fit_n"),
    )
    whole = daily.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.max(date_col).alias("last_date"), F.stddev_samp(value).alias("std_dev"))
    g = attach_scalars(whole, ends, by).where(F.col("n_rows") >= min_rows)
    g = g.withColumn("slope", F.when(F.col("_fit_n") >= 7, F.coalesce(F.col("_slope"), F.lit(0.0))).otherwise(0.0))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fc = F.greatest(F.lit(0.0), F.col("ma7_last") + F.col("slope") * F.col("i"))
    w = _w(by)
    out = (
        g.withColumn("forecast_date", F.date_add("last_date", F.col("i")))
        .withColumn("forecast", fc)
        .withColumn("lower", F.greatest(F.lit(0.0), F.col("forecast") - 1.96 * F.col("std_dev")))
        .withColumn("upper", F.col("forecast") + 1.96 * F.col("std_dev"))
    )
    out = (
        out.withColumn("total_forecast", F.sum("forecast").over(w))
        .withColumn("direction", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("stable"))
        .withColumn("daily_trend_pct", F.when(F.col("ma7_last") > 0, F.col("slope") / F.col("ma7_last") * 100).otherwise(0.0))
    )
    return out.drop("_slope", "_fit_n", "last_date", "n_rows")
