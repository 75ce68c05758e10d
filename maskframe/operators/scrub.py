"""The scrub projection: one filter on raw rows, then one select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import ScrubConfig
from ..plans.specs import TableSpec
from ..plans.tables import TablePlan, plan_table


def apply_plan(df: DataFrame, plan: TablePlan, salt: str) -> DataFrame:
    """Row-wise and shuffle-free, so it works on batch and streaming frames alike.

    Filter and select both see raw values only. A chain of ``withColumn`` would
    feed scrubbed values into later SQL rules, so all columns are made at once.
    """
    if plan.skipped:
        return df.filter(F.lit(False)).select(*[c.name for c in plan.spec.stored])
    if plan.rules.where:
        df = df.filter(F.expr(plan.rules.where))
    return df.select(*plan.select_list(salt))


def scrub(df: DataFrame, spec: TableSpec, cfg: ScrubConfig, salt: str) -> DataFrame:
    return apply_plan(df, plan_table(spec, cfg), salt)
