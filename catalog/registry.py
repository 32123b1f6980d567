"""Registry of queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog import proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (Proxies) -> DataFrame under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(proxies.Proxies(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return wrap


def with_ctes(body: str) -> str:
    """Prepend the table expressions that a statement uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, expr in proxies.CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(expr)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({proxies.CTES[n].strip()})" for n in needed)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
