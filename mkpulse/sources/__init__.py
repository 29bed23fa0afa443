"""Landed platform reports: declared schemas (``schemas``), row shaping
(``reports``, S01-S21) and catalog / ad-hoc access (``catalog``, S22-S24)."""

from mkpulse.sources import catalog, reports, schemas  # noqa: F401
