"""Registered queries: a Spark function over the driver tables and its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from passagework.plans.driver_views import DriverCorpus


@dataclass(frozen=True)
class Registered:
    build: Callable[[DriverCorpus], DataFrame]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the driver corpus; `sql` is its DuckDB equivalent."""

    def add(build: Callable[[DriverCorpus], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Registered(build, sql)
        return build

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    build = REGISTRY[name].build

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(DriverCorpus(spark, sf_dir))

    run.__name__ = name
    return run
