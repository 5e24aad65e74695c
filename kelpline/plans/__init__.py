"""Queries over the driver's tables, by family."""

from kelpline.plans import code, extras, graph, index, memory, retrieval, search, skeletons, telemetry

FAMILIES = [retrieval.family, telemetry.family, graph.family, index.family, memory.family, search.family, skeletons.family, extras.family, code.family]
