"""Registered queries by family; importing this package registers them all."""

from loomspark.plans import analytics, curation, evidence, graph, indexes, ingestion, memory, retrieval, stores, tools  # noqa: F401
