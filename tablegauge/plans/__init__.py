"""Named queries over the supplied tables, each with its SQL check."""

from importlib import import_module

MODULES = ("profiles", "reports", "relational", "metadata", "models", "analyses")


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"tablegauge.plans.{name}")
