"""Registered queries by subject; importing this package fills the registry."""

from plumbline.plans import aggregates, folds, graph, ordered, projection, quality, scalars, streams  # noqa: F401
