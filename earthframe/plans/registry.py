"""One place that knows every registered query and the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

#: Named SQL views over the driver tables, in dependency order.
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    SQL_VIEWS[name] = body.strip()


def _with_views(body: str) -> str:
    """Prefix ``body`` with the views it reaches, directly or through other views."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, view in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(view)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS (\n{v}\n)" for n, v in SQL_VIEWS.items() if n in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its equivalent."""

    def register(fn: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _with_views(sql.strip())
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
