"""The registered queries of the library, each beside its DuckDB twin."""

from __future__ import annotations

from strandline.queries import backtests, boards, details, files, grains, modelled, panels, reports  # noqa: F401
from strandline.queries.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
