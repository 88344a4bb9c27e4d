"""Registered queries, grouped as in the operator inventory."""

import importlib
import pkgutil

from factloom.plans.registry import REGISTRY

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["REGISTRY"]
