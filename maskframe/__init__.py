"""Scrubbed, audited snapshots of relational data on Spark."""

from .functions.transforms import builtin_names, new_salt
from .operators.scrub import scrub
from .plans.config import ConfigError, ScrubConfig, TableRules
from .plans.specs import ColumnSpec, ForeignKey, TableSpec, split_qualified
from .plans.tables import PlanError, TablePlan, plan
from .sources.layout import Layout
from .sources.manifests import Manifest, TableEntry, read_manifest, read_manifests
from .sources.restore import Restored, SnapshotRefused, restore
from .sources.snapshot import ShortRead, Snapshot, snapshot
from .sources.versions import PublishConflict, PublishRefused, Versions

__all__ = [
    "ColumnSpec", "ConfigError", "ForeignKey", "Layout", "Manifest", "PlanError", "PublishConflict", "PublishRefused",
    "Restored", "ScrubConfig", "ShortRead", "Snapshot", "SnapshotRefused", "TableEntry", "TablePlan", "TableRules", "TableSpec", "Versions",
    "builtin_names", "new_salt", "plan", "read_manifest", "read_manifests", "restore", "scrub", "snapshot",
    "split_qualified",
]
