"""Imports every query module so their ``@register`` calls fill the catalog."""

from __future__ import annotations

import importlib

from tablelens.plans.catalog import ORACLE, QUERIES

_MODULES = ["q_profile", "q_generic", "q_assoc", "q_series", "q_cluster", "q_features", "q_sources"]


def load_all():
    for m in _MODULES:
        importlib.import_module(f"tablelens.plans.{m}")
    return QUERIES, ORACLE
