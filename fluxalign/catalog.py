"""Registered queries of the experiment engine and their SQL."""

from __future__ import annotations

from .plans.oracles import build
from .plans.queries import REGISTRY


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return build()
