"""Query plans by area; importing the package fills the registry."""

from poolspark.plans import registry

AREAS = ["market", "crowd", "matching", "slips", "strategies", "category", "publish", "audit", "ingest", "dating", "entity", "nested",
         "pages", "functions", "streams", "sinks", "files"]


def load() -> tuple[dict, dict]:
    from importlib import import_module

    for area in AREAS:
        import_module(f"poolspark.plans.{area}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
