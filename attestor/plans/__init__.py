"""Registered queries over the driver tables."""

import pkgutil
from importlib import import_module


def load() -> None:
    """Import every module that registers queries."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            import_module(f"{__name__}.{module}")
