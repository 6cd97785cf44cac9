"""Named queries and their SQL twins."""

from __future__ import annotations


def registries():
    from . import composites, graphs, ingest, keys, retrieval, streams

    yield from (keys.R, ingest.R, retrieval.R, graphs.R, streams.R, composites.R)
