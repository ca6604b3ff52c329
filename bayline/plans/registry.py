"""A registry that keeps each query beside its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Collects queries; one instance per module of plans."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Decorate a (spark, sf_dir) query; sql is what DuckDB runs for the same rows."""

        def keep(function: Callable) -> Callable:
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return keep
