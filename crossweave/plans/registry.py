"""Registry of runnable queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles
from ..sources.market import Market
from .oracle_tables import with_tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Market], DataFrame]
    sql: str | None
    needs: tuple[str, ...]
    doubles: tuple[str, ...]
    recursive: bool
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", LARGEST_METHOD)
        return round_doubles(self.build(Market(spark, sf_dir)), self.digits)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_tables(self.sql, self.needs, self.doubles, self.recursive, self.digits)


# HotSpot never compiles a method beyond this size: a stage that would need one runs without whole-stage code instead
LARGEST_METHOD = "8000"


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, needs: str = "", doubles: str = "", sql: str | None = None, recursive: bool = False,
          digits: int = 6):
    """Register ``f(market) -> DataFrame`` under ``name``; ``covers`` lists inventory ids."""

    def add(f):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(
            name, tuple(covers.split()), f, sql, tuple(needs.split()), tuple(doubles.split()), recursive, digits
        )
        return f

    return add


def load_all() -> dict[str, Query]:
    from . import load_queries  # noqa: F401  (fills the registry)

    return REGISTRY
