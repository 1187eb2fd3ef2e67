"""Registry of queries: a DataFrame builder, its result columns, and the SQL it is checked with.

Result columns are given as one string. A suffix says how a column is made comparable between
engines: ``name~`` rounds to 6 decimals, ``name~4`` to 4, ``name@`` writes a date as ISO text,
``name#`` makes an integer 64 bits wide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazelake.catalog.ctes import with_tables
from hazelake.catalog.tables import Tables
from hazelake.session import tuned

_COLUMN = re.compile(r"^(\w+?)(?:(~)(\d*)|(@)|(#))?$")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: str | None
    sql: str | None
    extra: dict[str, str]


QUERIES: dict[str, Query] = {}


def _parse(columns: str):
    for word in columns.split():
        name, rounded, digits, date, wide = _COLUMN.match(word).groups()
        yield name, (int(digits or 6) if rounded else None), bool(date), bool(wide)


def finish(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, digits, date, wide in _parse(columns):
        c = F.col(name)
        if digits is not None:
            # Spark's round goes through decimal text; plain arithmetic is the same in any engine
            scale = F.lit(10.0**digits)
            c = F.floor(c.cast("double") * scale + 0.5) / scale
        elif date:
            c = c.cast("string")
        elif wide:
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(body: str, columns: str, extra: dict[str, str]) -> str:
    out = []
    for name, digits, date, wide in _parse(columns):
        c = f'"{name}"'
        if digits is not None:
            c = f"floor(CAST({c} AS DOUBLE) * 1e{digits} + 0.5e0) / 1e{digits}"
        elif date:
            c = f"CAST({c} AS VARCHAR)"
        elif wide:
            c = f"CAST({c} AS BIGINT)"
        out.append(f'{c} AS "{name}"')
    return with_tables(f"SELECT {', '.join(out)} FROM (\n{body}\n) AS result", extra)


def query(name: str, columns: str | None = None, sql: str | None = None, **extra: str):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(name, build, columns, sql, extra)
        return build

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = q.build(Tables(tuned(spark), sf_dir))
            return finish(df, q.columns) if q.columns else df

        return run

    return {name: runner(q) for name, q in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    return {n: finish_sql(q.sql, q.columns, q.extra) for n, q in QUERIES.items() if q.sql}
