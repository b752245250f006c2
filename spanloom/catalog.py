"""All queries of the engine with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from . import queries as _modules
from .queries import base

FLAGSHIP = "R01_redact_documents"

for _m in pkgutil.iter_modules(_modules.__path__):
    importlib.import_module(f"{_modules.__name__}.{_m.name}")


def queries() -> dict[str, Callable]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
