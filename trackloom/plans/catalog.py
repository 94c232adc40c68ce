"""Registry of named queries with the SQL text that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.numbers import settle_sql, settled
from trackloom.plans.views import Inputs, with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``Inputs -> DataFrame`` under its own name."""

    def register(build: Callable[[Inputs], DataFrame]):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            counted = sql.replace("count_if(", "count(*) filter (where ")
            ORACLE[name] = with_views(settle_sql(counted))
        return build

    return register


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """The named columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[settled(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in keep])
