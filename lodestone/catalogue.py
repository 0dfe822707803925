"""All queries of the analytics engine by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from lodestone.plans import ranking, sessions, streams, structures  # noqa: F401  (they fill the registry)
from lodestone.plans.views import REGISTRY
from lodestone.ship import ship


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
