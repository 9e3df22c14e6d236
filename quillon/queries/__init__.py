"""Queries of the library over the tables region to events and documents."""

from quillon.queries import building, loading, scalar, search, serving

__all__ = ["building", "loading", "scalar", "search", "serving"]
