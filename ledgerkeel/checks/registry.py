"""Registered checks: a Spark query and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BODIES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _mentions(text: str, own: str = "") -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [name for name in CTES if name in words and name != own]


def with_ctes(body: str) -> str:
    """Put the named inputs the body mentions in front of it, each after its own inputs."""
    placed: list[str] = []

    def place(name: str) -> None:
        if name not in placed:
            for inner in _mentions(CTES[name], name):
                place(inner)
            placed.append(name)

    for name in _mentions(body):
        place(name)
    # Recursive inputs name their columns.
    heads = {n: f"{n}(grp, idx, h)" if n.startswith("chain_") else n for n in placed}
    parts = [f"{heads[n]} AS ({CTES[n]})" for n in placed]
    return f"WITH RECURSIVE {', '.join(parts)} {body.strip()}" if parts else body.strip()


def oracles() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in _BODIES.items()}


def check(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"check {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _BODIES[name] = sql
        return fn

    return register
