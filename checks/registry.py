from __future__ import annotations

from pyspark.sql import Column, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def rnd(name: str, places: int = 6) -> Column:
    return F.round(F.col(name), places).alias(name)


def pick(df, *names: str, **places: int):
    """Columns in order; those named in ``places`` rounded."""
    return df.select(*[F.col(n) for n in names], *[rnd(n, p) for n, p in places.items()])
