"""Registered queries, one module per operator family."""

import importlib

MODULES = [
    "scalars", "hops", "repair", "infer", "graph", "diff", "union", "velocity", "delay", "validate", "routing", "sources",
    "sinks", "stream", "chains",
]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"hoptrail.plans.{m}")
