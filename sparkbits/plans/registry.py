"""All registered queries of the engine itself."""

from __future__ import annotations

from . import bits, tables  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
