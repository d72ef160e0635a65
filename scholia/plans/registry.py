"""Query registry: a Spark callable next to its DuckDB statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholia.plans.views import ORACLE_VIEWS, Tables
from scholia.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` and, if expressible, its SQL."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return wrap


def with_views(body: str) -> str:
    """Prefix the derived views a statement mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[vo]_[a-z0-9_]+\b", text):
            if word in ORACLE_VIEWS and word not in needed:
                visit(ORACLE_VIEWS[word])
                needed.append(word)

    visit(body)
    body = body.strip()
    recursive = re.match(r"(?i)with\s+recursive\s", body) is not None
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({ORACLE_VIEWS[n].strip()})" for n in needed)
    if not needed:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if own:
        return f"{head}{ctes},\n{body[own.end():]}"
    return f"{head}{ctes}\n{body}"
