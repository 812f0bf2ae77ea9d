"""The register of queries: each operator bound to the given tables, with SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bind import entity, with_entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Given tables and derived entities of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return entity(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers ``f(tables) -> DataFrame``; ``uses`` names the entities of the SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_entities(uses.split(), sql)
        return f

    return add
