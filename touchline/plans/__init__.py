"""Named queries over the test tables."""

from __future__ import annotations

from functools import lru_cache

from touchline.plans.registry import Registry


@lru_cache(maxsize=1)
def load_registry() -> Registry:
    """All queries of the core, in one registry."""
    from touchline.plans import masters, models, pipeline, training, warehouse

    registry = Registry()
    training.register(registry)
    warehouse.register(registry)
    models.register(registry)
    masters.register(registry)
    pipeline.register(registry)
    return registry
