"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from packetloom.sources.fixtures import TEMPLATES, fixture_sql

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None
    about: str


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None) -> Callable[[Build], Build]:
    """Register the function under its own name."""

    def register(build: Build) -> Build:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        about = (build.__doc__ or "").strip().splitlines()
        QUERIES[name] = Query(name, build, oracle, about[0] if about else "")
        return build

    return register


def sql(select: str, **ctes: str) -> str:
    """``select`` below the derived views it names and further named parts."""
    parts = []
    everything = " ".join([select, *ctes.values()])
    for name in TEMPLATES:
        if name in everything:
            parts.append(f"{name} AS ({fixture_sql(name)})")
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
