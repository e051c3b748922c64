"""Named query catalogue: each entry is a Spark plan over the input tables
plus, where SQL can express it, the equivalent DuckDB query used as oracle.

Outputs are kept flat and hash-stable across engines: integers as bigint,
doubles rounded to 6 places, arrays rendered as joined text, timestamps as
fixed-format text.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: Optional[str] = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from railyard.session import ship_package
            ship_package(spark)
            # input times are timestamp_ntz wall clocks; the conversions to
            # instants (watermarks, buckets, UUID times) assume UTC
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return normalize(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def normalize(df: DataFrame) -> DataFrame:
    """Integers to bigint, floats rounded to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c, 6).cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def queries() -> dict[str, QueryFn]:
    import railyard.plans.catalog  # noqa: F401  (registers everything)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import railyard.plans.catalog  # noqa: F401
    return dict(_SQL)
