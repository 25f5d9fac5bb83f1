"""The library's queries by name."""

from __future__ import annotations

from tessera.plans import identifiers, models, quality, streams  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES
