"""Errors raised before a plan is built."""

from __future__ import annotations


class IndexNotFound(Exception):
    """There is no index under the given root."""

    def __init__(self, root: str):
        super().__init__(f"no index found at {root}; create one first")
        self.root = root


class CollectionNotFound(Exception):
    """The index exists but has no collection of that name."""

    def __init__(self, name: str, available: list[str]):
        super().__init__(f"collection {name!r} not found; available: {', '.join(available) or 'none'}")
        self.name = name
        self.available = available


class CollectionExists(Exception):
    """A collection of that name is already there and `force` was not given."""

    def __init__(self, name: str):
        super().__init__(f"collection {name!r} already exists; use force=True to recreate the index")
        self.name = name


class ModelMismatch(Exception):
    """A search used another model or dimension than the collection was built with."""


class HierarchyCycle(Exception):
    """The parent links of the given chunks contain a cycle."""
