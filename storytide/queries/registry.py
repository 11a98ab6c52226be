"""Where queries register."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if that can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int = 3) -> str:
    """SQL for rounding halves up, as functions.numeric.half_up."""
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits}.0)"
