"""DataFrame operators: aggregates (A), joins (J), windows (W), top-k and set
operators (T), scores and classifications (N01-N13), rule-based insights
(N14-N25) and data-quality checks (Q). Every operator is a lazy
``DataFrame -> DataFrame`` function with an optional ``by=[entities]``."""

from mkpulse.operators import aggregates, insights, joins, quality, scoring, topk, windows  # noqa: F401
