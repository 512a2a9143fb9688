"""Queries over fixtures: every document gets one of a list of small inputs, by its key, so that rules that the tables hardly
ever meet are held against known results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_queries import ORACLE, QUERIES, documents, quoted


def value(x: str | int | None) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    return quoted(x) if isinstance(x, str) else str(x)


def golden(columns: str, rows: list[tuple]):
    """Registers a query by what each input comes to.

    ``rows``: an input and the values of ``columns`` (all text) that the query gives for it. The function gets the documents
    with ``doc_id`` and ``given``, the input, and gives doc_id and the columns.
    """
    names = columns.split()

    def add(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            given = F.get(F.array(*[F.lit(r[0]) for r in rows]), (F.col("doc_id") % len(rows)).cast("int"))
            return f(documents(spark, d).select("doc_id", given.alias("given"))).select("doc_id", *names)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        table = ", ".join(f"({i}, {', '.join(map(value, r[1:]))})" for i, r in enumerate(rows))
        sql = f"SELECT doc_id, {', '.join(f'g.{n}' for n in names)} FROM documents JOIN (VALUES {table}) g(i, {', '.join(names)}) ON doc_id % {len(rows)} = g.i"
        QUERIES[f.__name__], ORACLE[f.__name__] = run, sql
        return run

    return add


def once(df: DataFrame, f: Callable[[DataFrame], DataFrame], key: str = "given") -> DataFrame:
    """What ``f`` makes of the distinct inputs, joined back to the documents."""
    made = f(df.select(key).distinct()).withColumnRenamed(key, "_given")
    return df.join(made, F.col(key) == F.col("_given")).drop("_given")


def listed(array: Column, f: Callable[[Column], Column] = lambda x: x, sep: str = " ~ ") -> Column:
    """An array's items as one text."""
    return F.array_join(F.transform(array, f), sep, "-")
