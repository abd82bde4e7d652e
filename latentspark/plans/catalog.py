"""Every query of the library bound to the test tables, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, queries_base, queries_decode, queries_extra, queries_more, queries_stats

_ALL = [*queries_base.QUERIES, *queries_decode.QUERIES, *queries_stats.QUERIES, *queries_more.QUERIES, *queries_extra.QUERIES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["m3_shuffle_test_marginal"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {q.name: sql for q in _ALL if (sql := oracles.SQL.get(q.name, q.sql))}
