"""The queries of this package and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import keylode.llm as package


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(package.__path__) if m.name.startswith("op"))
    return [importlib.import_module(f"keylode.llm.{n}") for n in names]


def queries() -> dict:
    return dict(m.QUERY for m in _modules())


def oracle_sql() -> dict:
    return {m.QUERY[0]: m.ORACLE for m in _modules() if m.ORACLE}
