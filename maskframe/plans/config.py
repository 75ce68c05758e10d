"""The scrub rule set: strict to read, and checked against itself before any job runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .specs import SpecError, split_qualified

try:
    import yaml
except ImportError:  # rule sets can still be given as JSON text or as a dict
    yaml = None

CONFIG_VERSION = 1

FK_VALIDATE = "validate"
FK_NOT_VALID = "not_valid"
MODE_FULL = ""
MODE_SKIP = "skip"


class ConfigError(SpecError):
    pass


@dataclass(frozen=True)
class TableRules:
    mode: str = MODE_FULL
    where: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)

    @property
    def skip(self) -> bool:
        return self.mode == MODE_SKIP


NO_RULES = TableRules()


@dataclass(frozen=True)
class ScrubConfig:
    version: int = CONFIG_VERSION
    fk_mode: str = FK_VALIDATE
    tables: Mapping[str, TableRules] = field(default_factory=dict)

    @classmethod
    def parse(cls, source: str | bytes | Mapping[str, Any]) -> ScrubConfig:
        """Read YAML or JSON text, or a mapping. One error lists every problem."""
        raw = source if isinstance(source, Mapping) else _load_text(source)
        if not isinstance(raw, Mapping):
            raise ConfigError(["a rule set is a mapping with version, fk_mode and tables"])

        problems: list[str] = []
        _unknown_keys(raw, ("version", "fk_mode", "tables"), "rule set", problems)
        tables = {}
        declared = raw.get("tables") or {}
        if not isinstance(declared, Mapping):
            problems.append("`tables` must be a mapping")
            declared = {}
        for name, body in declared.items():
            body = body or {}
            if not isinstance(body, Mapping):
                problems.append(f"{name}: rules are a mapping of mode, where and columns")
                continue
            _unknown_keys(body, ("mode", "where", "columns"), name, problems)
            columns = body.get("columns") or {}
            if not isinstance(columns, Mapping):
                problems.append(f"{name}: `columns` maps column names to rules")
                columns = {}
            tables[str(name)] = TableRules(
                mode=_text(body.get("mode")),
                where=_text(body.get("where")),
                columns={str(c): _text(t) for c, t in columns.items()},
            )
        try:
            version = int(raw.get("version") or 0)
        except (TypeError, ValueError):
            problems.append(f"version {raw['version']!r} is not a number")
            version = CONFIG_VERSION
        cfg = cls(version=version, fk_mode=_text(raw.get("fk_mode")) or FK_VALIDATE, tables=tables)
        problems += cfg.problems()
        if problems:
            raise ConfigError(problems)
        return cfg

    def problems(self) -> list[str]:
        out = []
        if self.version != CONFIG_VERSION:
            out.append(f"rule sets of version {self.version} are not known here; this reads version {CONFIG_VERSION}")
        if self.fk_mode not in (FK_VALIDATE, FK_NOT_VALID):
            out.append(f'fk_mode is validate or not_valid, not "{self.fk_mode}"')
        for name in self.table_names():
            rules = self.tables[name]
            try:
                split_qualified(name)
            except ValueError as e:
                out.append(str(e))
            if rules.mode not in (MODE_FULL, MODE_SKIP):
                out.append(f'{name}: the only mode to set is skip, not "{rules.mode}"')
            if rules.skip and rules.where:
                out.append(f"{name}: skipped, so there are no rows for `where`")
            if rules.skip and rules.columns:
                out.append(f"{name}: skipped, so there are no rows for `columns`")
            out += [
                f"{name}.{c}: the rule is blank"
                for c in sorted(rules.columns)
                if not rules.columns[c].strip()
            ]
        return out

    def table_names(self) -> list[str]:
        return sorted(self.tables)

    def rules_for(self, qualified: str) -> TableRules:
        return self.tables.get(qualified, NO_RULES)

    def sha256(self) -> str:
        """Identifies the rule set without reproducing it."""
        body = {
            "version": self.version,
            "fk_mode": self.fk_mode,
            "tables": {
                n: {"mode": r.mode, "where": r.where, "columns": dict(r.columns)}
                for n, r in self.tables.items()
            },
        }
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per rule; a table with only a mode or filter has a NULL column."""
        rows = []
        for name in self.table_names():
            columns = self.tables[name].columns
            rows += [(name, c, columns[c]) for c in sorted(columns)] or [(name, None, None)]
        return spark.createDataFrame(rows, "table string, column string, transform string")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _unknown_keys(raw: Mapping, known: tuple[str, ...], where: str, problems: list[str]) -> None:
    problems += [f"{where}: unknown key `{k}`" for k in raw if k not in known]


def _load_text(source: str | bytes) -> Any:
    text = source.decode() if isinstance(source, bytes) else source
    try:
        if yaml is None:
            return json.loads(text, object_pairs_hook=_no_duplicates)
        return yaml.load(text, Loader=_rules_loader())
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError([f"the rule set cannot be read: {e}"]) from e


def _no_duplicates(pairs):
    out = {}
    for key, value in pairs:
        if key in out:
            raise ConfigError([f"the rule set cannot be read: `{key}` appears twice"])
        out[key] = value
    return out


def _rules_loader():
    """Scalars stay text as written (``yes``, ``042``); only an unquoted null is special."""

    class RulesLoader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            return _no_duplicates(
                (self.construct_object(k, deep=True), self.construct_object(v, deep=True))
                for k, v in node.value
            )

    RulesLoader.yaml_implicit_resolvers = {
        first: [(tag, pattern) for tag, pattern in found if tag == "tag:yaml.org,2002:null"]
        for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    RulesLoader.add_constructor(
        "tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node)
    )
    return RulesLoader
