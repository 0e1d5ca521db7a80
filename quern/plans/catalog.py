"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from quern.plans import prep, q_bars, q_grid, q_market

_MODULES = (prep, q_grid, q_bars, q_market)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = "hypothesis_metrics"
