"""How a query is registered: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.config import ScrubConfig
from ..plans.specs import TableSpec
from ..sources.tables import open_parquet

Run = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
SALT = "grain-of-7"

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return register


def open_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The given tables under their qualified names."""
    paths = {f"public.{n}": f"{sf_dir}/{n}.parquet" for n in names or TABLES}
    return open_parquet(spark, paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec_of(df: DataFrame, name: str, **declared) -> TableSpec:
    return TableSpec.from_df(f"public.{name}", df, **declared)


def rules(name: str, *, where: str = "", mode: str = "", **columns: str) -> ScrubConfig:
    body = {k: v for k, v in (("where", where), ("mode", mode), ("columns", columns)) if v}
    return ScrubConfig.parse({"version": 1, "tables": {f"public.{name}": body}})
