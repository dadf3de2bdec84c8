"""All named queries."""

from __future__ import annotations

import importlib

AREAS = ("prepare", "detection", "forecasting", "statistics", "graphs", "deployment")


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"sensorloom.catalog.{area}")


def queries():
    from sensorloom.catalog.base import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql():
    from sensorloom.catalog.base import ORACLES

    _load()
    return dict(ORACLES)
