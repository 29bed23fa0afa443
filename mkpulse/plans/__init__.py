"""Query plans: adapters over the driver tables and the registered queries."""

from mkpulse.plans.catalog import REGISTRY, finalize  # noqa: F401


def load_all() -> dict:
    """Import every query module (each registers its queries) and return the registry."""
    from mkpulse.plans import (  # noqa: F401
        q_aggregates, q_analytics, q_entities, q_functions, q_insights, q_quality, q_sinks, q_sources, q_streaming,
        q_views,
    )

    return REGISTRY


def run(name: str, spark, sf_dir: str):
    load_all()
    from mkpulse.plans import catalog

    return catalog.run(name, spark, sf_dir)
