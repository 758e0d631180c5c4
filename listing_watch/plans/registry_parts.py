"""What the modules of registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views as v

Query = Callable[[SparkSession, str], DataFrame]

#: SQL: a term of which nothing is left without the words of the card rules, longest first.
OWN = "length(regexp_replace(replace(replace(replace(tterm, 'here', ''), 'this', ''), 'the', ''), '\\s', '', 'g')) < 1"


def registrar(queries: dict[str, Query], oracles: dict[str, str]):
    """A decorator that registers a query under its function's name, with its SQL where there is one:
    a text `sql`, or `select` behind the expressions of `views` that it needs."""

    def query(needs: list[str] | None = None, select: str | None = None, name: str | None = None, sql: str | None = None):
        def keep(f: Query) -> Query:
            n = name or f.__name__
            queries[n] = f
            if sql is not None:
                oracles[n] = sql
            elif select is not None:
                oracles[n] = v.sql(needs or [], select)
            return f

        return keep

    return query
