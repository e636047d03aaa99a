"""Registered queries. Importing ``load_all`` fills the registry."""

from __future__ import annotations

import importlib

MODULES = (
    "commerce",
    "relational",
    "quality",
    "runs",
    "corpus",
    "intent",
    "retrieval",
    "answers",
    "evaluation",
    "streaming",
)


def load_all():
    from quayside.plans import registry

    for module in MODULES:
        importlib.import_module(f"quayside.plans.{module}")
    return registry.QUERIES
