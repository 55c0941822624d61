"""Query registration and the inputs shared by both formulations."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from groundcover.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def derive(spark: SparkSession, folder: str, template: str) -> DataFrame:
    """Runs an input template in Spark; `{customer}` stands for that table."""
    tables = {name for _, name, _, _ in Formatter().parse(template) if name}
    return spark.sql(template, **{t: load_table(spark, folder, t) for t in sorted(tables)})


def plain(template: str) -> str:
    """The same template as SQL over tables of those names."""
    tables = {name for _, name, _, _ in Formatter().parse(template) if name}
    return template.format(**{t: t for t in tables})


def with_inputs(body: str, **templates: str) -> str:
    """`WITH name AS (...)` for the given input templates, then `body`."""
    parts = [f"{name} AS ({plain(t)})" for name, t in templates.items()]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
