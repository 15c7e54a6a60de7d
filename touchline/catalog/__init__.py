"""Registered queries: name -> (DataFrame builder, SQL text or None)."""

from touchline.catalog import chain, frames, geometry, graphs, joined, learned, naming, sinks, teams

REGISTRY = {}
for module in (frames, joined, geometry, naming, teams, graphs, learned, chain, sinks):
    REGISTRY.update(module.QUERIES)
