"""A small decorator that pairs a query with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteplane.plans.bench_views import Views


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return f

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0 made 0), so that engines agree in value."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
