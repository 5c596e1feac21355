"""A small registry: one decorator registers a query with its oracle."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None) -> Callable:
        def register(query: Callable) -> Callable:
            self.queries[query.__name__] = query
            if oracle is not None:
                self.oracles[query.__name__] = oracle
            return query

        return register
