"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = [
    "rules_and_stages", "text_features", "reporting", "reviewing", "sources_and_sinks", "training_data", "classifier", "streams",
]


def load():
    from modsieve.plans import registry

    for name in MODULES:
        importlib.import_module(f"modsieve.plans.{name}")
    return registry.QUERIES, registry.SQL
