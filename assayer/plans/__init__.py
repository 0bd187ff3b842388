"""Registered queries over the given tables."""

from assayer.plans.registry import Query


def all_queries() -> dict[str, Query]:
    from assayer.plans import engine, governance, profiling, sources, statistics

    out: dict[str, Query] = {}
    for module in (profiling, engine, statistics, governance, sources):
        for name, query in module.QUERIES.items():
            if name in out:
                raise KeyError(f"query registered twice: {name}")
            out[name] = query
    return out
