"""V11, incremental: gold facts follow changed bronze partitions.

A fact's rows of one day come from its bronze tables' rows of that day alone
(V05-V08). So when days of a bronze table change, those days of the facts that
depend on it are built again and exchanged, and nothing else is read. Which
bronze files a fact was built from is kept in the fact's ledger and changes in
the same commit as its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from mkpulse.plans.views import VIEW_ORDER, build_views
from mkpulse.sinks import _in_values, ledger, partition_stamps, partition_values, path_exists, recover, replace_partitions

#: Facts that hold days of their inputs as they are.
DAILY_FACTS = ("fact_paid_daily", "fact_paid_adgroup_daily", "fact_organic_daily", "fact_organic_queries", "fact_web_daily", "fact_web_traffic")
DAY = "date_day"


def bronze_of(view: str) -> list[str]:
    """The bronze tables that a view is built from, through all views between."""
    deps = {name: inputs for name, inputs, _ in VIEW_ORDER}
    out, todo = set(), [view]
    while todo:
        for d in deps[todo.pop()]:
            d = d.removeprefix("?")
            todo += [d] if d in deps else []
            out |= set() if d in deps else {d}
    return sorted(out)


def refresh_facts(spark: SparkSession, bronze: Mapping[str, str], gold: str, facts: Sequence[str] = DAILY_FACTS) -> dict[str, list[str]]:
    """Bring the facts below ``gold`` up to date with the bronze tables (name -> path, partitioned by ``date_day``).

    Returns for each fact the day folders rewritten. A fact whose bronze
    tables are not all there is left out."""
    out: dict[str, list[str]] = {}
    stamps = {}
    for fact in facts:
        tables = bronze_of(fact)
        for t in tables:
            if t in bronze and t not in stamps and path_exists(spark, bronze[t]):
                recover(spark, bronze[t])
                stamps[t] = partition_stamps(spark, bronze[t])
        if any(t not in stamps for t in tables):
            continue
        path = f"{gold.rstrip('/')}/{fact}"
        recover(spark, path)
        then = ledger(spark, path).get("stamps", {})
        now = {t: stamps[t] for t in tables}
        days = sorted({f for t in tables for f in {*now[t], *then.get(t, {})} if now[t].get(f) != then.get(t, {}).get(f)})
        out[fact] = days
        if not days:
            continue
        values = list(partition_values(spark, days, T.DateType()).values())
        frames = {t: spark.read.parquet(bronze[t]).where(_in_values(DAY, values)) for t in tables}
        views, report = build_views(frames, only=[fact])
        if fact not in views:
            raise ValueError(f"{fact}: {'; '.join(f'{n} {s} {e}' for n, s, e in report if s != 'created')}")
        replace_partitions(views[fact].where(_in_values(DAY, values)), path, DAY, days, {"stamps": now})
    return out
