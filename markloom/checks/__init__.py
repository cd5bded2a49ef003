"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_checks"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    from markloom.checks.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from markloom.checks.registry import ORACLES

    _load()
    return dict(ORACLES)
