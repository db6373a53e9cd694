"""The registered queries of the library and their SQL oracles."""

from __future__ import annotations

from framelens.plans import files, learning, relations, statistics  # noqa: F401  registering
from framelens.plans.learning import flagship  # noqa: F401
from framelens.plans.registered import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
