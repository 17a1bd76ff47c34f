"""Registered queries over the tables of a data folder."""

from quern.plans import relational, selection, streams

REGISTRIES = [selection.REGISTRY, relational.REGISTRY, streams.REGISTRY]
