"""Loads every query section; holds the flagship query."""
from __future__ import annotations

import importlib
import pkgutil

from . import __path__ as _path

for _m in sorted(m.name for m in pkgutil.iter_modules(_path)):
    if _m.startswith("s") and _m[1:3].isdigit():
        importlib.import_module(f"{__package__}.{_m}")


def flagship(spark, sf_dir):
    from .registry import QUERIES
    return QUERIES["kruskal_wallis"](spark, sf_dir)
