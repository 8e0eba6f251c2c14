"""All registered queries, one module per inventory section."""

from __future__ import annotations

import importlib

from .registry import CATALOGUE, Query

MODULES = ("metrics", "quality", "clean", "stats", "timeseries", "survival", "causal", "market", "lifecycle",
           "emergence", "models", "factors", "extinction", "events")


def catalogue() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return CATALOGUE
