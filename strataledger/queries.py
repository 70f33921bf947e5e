"""All named queries of the library, and the SQL of those that SQL can express."""

from __future__ import annotations

from strataledger.plans import learning, ledger, statistics, storage  # noqa: F401  (they register themselves)
from strataledger.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
