"""Resolve every rule against the real schemas before any data moves."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import transforms
from .config import ScrubConfig, TableRules
from .specs import ColumnSpec, SpecError, TableSpec


class PlanError(SpecError):
    pass


@dataclass(frozen=True)
class TablePlan:
    spec: TableSpec
    rules: TableRules

    @property
    def skipped(self) -> bool:
        return self.rules.skip

    @property
    def columns(self) -> list[str]:
        """The exported columns in order; a skipped table exports none."""
        return [] if self.skipped else [c.name for c in self.spec.stored]

    @property
    def transforms(self) -> dict[str, str]:
        """The configured rule per column, never the expression made from it: that holds the salt."""
        return dict(self.rules.columns)

    def select_list(self, salt: str) -> list[Column]:
        return [self._rendered(c, salt).alias(c.name) for c in self.spec.stored]

    def _rendered(self, col: ColumnSpec, salt: str) -> Column:
        rule = self.rules.columns.get(col.name)
        if rule is None:
            return transforms.source_column(col.name)
        return transforms.render(col, rule, salt)


def table_problems(spec: TableSpec, rules: TableRules) -> list[str]:
    if spec.partitioned:
        return [f"{spec.qualified}: a partitioned table has no rows of its own; its leaves have them"]
    out = []
    for name in sorted(rules.columns):
        col = spec.column(name)
        where = f"{spec.qualified}.{name}"
        if col is None:
            out.append(f"{where}: no such column")
        elif col.generated is not None:
            out.append(f"{where}: generated from other columns when loaded, so no rule applies to it")
        elif not rules.skip:
            builtin = transforms.lookup_builtin(rules.columns[name])
            try:
                if builtin is not None:
                    transforms.BUILTINS[builtin](col, "")
            except ValueError as e:
                out.append(f"{where}: {e}")
    if not out and not rules.skip and not spec.stored:
        out.append(f"{spec.qualified}: every column is generated, nothing is left to export")
    return out


def plan_table(spec: TableSpec, cfg: ScrubConfig) -> TablePlan:
    rules = cfg.rules_for(spec.qualified)
    problems = table_problems(spec, rules)
    if problems:
        raise PlanError(problems)
    return TablePlan(spec, rules)


def plan(specs: Iterable[TableSpec], cfg: ScrubConfig) -> list[TablePlan]:
    """One plan per exportable table, or one error naming every problem found.

    Partitioned parents are left out: their rows are in their leaves. A rule that
    names one, or a table that is not there, is reported because it would never apply.
    """
    known = {s.qualified: s for s in specs}
    problems, plans = [], []
    for spec in known.values():
        if spec.partitioned:
            continue
        found = table_problems(spec, cfg.rules_for(spec.qualified))
        problems += found
        if not found:
            plans.append(TablePlan(spec, cfg.rules_for(spec.qualified)))
    for name in cfg.table_names():
        if name not in known:
            problems.append(f"{name}: no such table")
        elif known[name].partitioned:
            problems.append(f"{name}: rules on a partitioned table reach no row; put them on its leaves")
    if not plans and not problems:
        problems.append("there is no table to export")
    if problems:
        raise PlanError(problems)
    return sorted(plans, key=lambda p: p.spec.qualified)
