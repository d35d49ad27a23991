"""Registry of the engine's queries and of the SQL that each must agree with."""

from __future__ import annotations

_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def frame(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
