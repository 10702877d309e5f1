"""Bindings, registered queries and end-to-end flows."""

from importlib import import_module

SUITES = ("evidence", "scalar", "regions", "metrics", "ranking", "joins", "spatial", "sampling", "ledger", "tiles")


def load_entries():
    """Import every suite once and return the registered queries by name."""
    from surfaudit.plans.registry import ENTRIES

    for suite in SUITES:
        import_module(f"surfaudit.plans.suite_{suite}")
    return dict(ENTRIES)
