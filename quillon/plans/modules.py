"""The modules that register queries."""

import importlib

NAMES: tuple[str, ...] = ("search", "maintain", "textual", "graphs", "documents", "reporting", "evidence", "knowledge")


def load() -> None:
    for name in NAMES:
        importlib.import_module(f"quillon.plans.{name}")
