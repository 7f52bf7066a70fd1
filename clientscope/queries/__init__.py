"""Registered queries, one module per group of operators."""

from importlib import import_module

MODULES = (
    "scans", "predicates", "joins", "aggregates", "windows", "scalars", "rolling", "client_plans", "category_plans",
    "targets", "evaluation", "models", "quality", "chain",
)


def load():
    """Import every query module once and return the registry."""
    for m in MODULES:
        try:
            import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if not str(e).endswith(f"{m}'"):
                raise
    return import_module(f"{__name__}.registry")
