"""Named queries with their SQL checks.

A query's output columns are declared once as ``"name kind"``: s text, d date as ISO text, i integer, or the
number of digits a double is rounded to. The same declaration finishes the Spark result and the SQL text, so
both sides carry the same names and types.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.rounding import nudge, rounded

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    run: Run
    sql: str | None

    def dataframe(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(spark, sf_dir).select(*[spark_column(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return f"SELECT {', '.join(sql_column(n, k) for n, k in self.columns)} FROM (\n{self.sql}\n) AS result"


def spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "d":
        return c.cast("date").cast("string").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    return rounded(c, int(kind)).alias(name)


def sql_column(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    return f"round(CAST({name} AS DOUBLE) + {nudge(int(kind))!r}, {kind}) + CAST(0 AS DOUBLE) AS {name}"


CTES: dict[str, str] = {}
# Subqueries that the check engine has to compute once: inlined several times they end in an internal error there.
MATERIALIZED: set[str] = set()
QUERIES: dict[str, Query] = {}


def cte(name: str, text: str, materialized: bool = False) -> None:
    """A shared named subquery; later ones may use earlier ones."""
    assert name not in CTES, name
    CTES[name] = text.strip()
    if materialized:
        MATERIALIZED.add(name)


def closure(text: str) -> list[str]:
    """The shared subqueries a text needs, in definition order."""
    wanted: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in CTES:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(CTES[name])
    return [n for n in CTES if n in wanted]


def with_ctes(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the shared subqueries it names. A body may start with its own WITH list."""
    own = body.strip()
    parts = [f"{n} AS {'MATERIALIZED ' * (n in MATERIALIZED)}(\n{CTES[n]}\n)" for n in closure(own)]
    word = "WITH RECURSIVE" if recursive else "WITH"
    if own.upper().startswith("WITH "):
        own = own[5:]
        return f"{word} " + ",\n".join([*parts, own])
    return f"{word} " + ",\n".join(parts) + f"\n{own}" if parts else own


def register(name: str, columns: str, sql: str | None = None, recursive: bool = False) -> Callable[[Run], Run]:
    pairs = tuple(tuple(c.split()) for c in columns.split(","))

    def keep(run: Run) -> Run:
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, pairs, run, None if sql is None else with_ctes(sql, recursive))
        return run

    return keep
