"""Stage, audit, publish: a new version becomes visible only when every check passed.

Versions of a target live side by side. A small log of (target, name, role, at)
says which one is current; a version's role is the newest entry for its name.
Publishing appends both changes of role in one write, so readers see the old
version or the new one and nothing in between.

Entries are numbered and an entry is created only where its number is free. Who finds it
taken looks at the log again and decides anew, so every change follows from the entry before it,
whoever wrote that. Two runs on one target may stage side by side; the first to publish wins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import staging_name
from ..operators import registry
from ..operators.reports import ERROR, union_all
from ..workspace import create_new, path_exists, remove
from .layout import path_part

LOG_SCHEMA = "target string, name string, role string, at string, seq int"
DROPPED = "dropped"
NEXT_VALUES = "_next_values"
SKETCHES = "_sketches"
NOBODY = ""

# Names by role, oldest first, and the changes of role that follow from them.
Roles = dict[str, list[str]]
Changes = Sequence[tuple[str, str]]


class PublishRefused(RuntimeError):
    def __init__(self, violations: Sequence[str]):
        self.violations = list(violations)
        super().__init__("not published: " + "; ".join(self.violations))


class PublishConflict(RuntimeError):
    """Another run published to the target, or gave the staged version up, in the meantime."""


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _stamp(at: datetime) -> str:
    return at.isoformat(timespec="microseconds")


@dataclass(frozen=True)
class Versions:
    """The versions of all targets below one folder."""

    spark: SparkSession
    root: str

    def _log(self, target: str) -> str:
        """One log per target: runs for different targets never write to the same folder."""
        return f"{self.root.rstrip('/')}/{target if target == '*' else path_part(target)}/_versions"

    def path(self, target: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{path_part(target)}/{path_part(name)}"

    def table_path(self, target: str, name: str, table: str) -> str:
        return f"{self.path(target, name)}/{path_part(table)}"

    def _newest(self, target: str) -> DataFrame:
        """(target, name, role, since, number) of every name in the log; ``number`` is that of its newest entry."""
        place = self._log(target)
        if path_exists(self.spark, place):
            log = self.spark.read.schema(LOG_SCHEMA).json(place)
            log = log.withColumn("number", F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("bigint"))
        else:
            log = self.spark.createDataFrame([], LOG_SCHEMA).withColumn("number", F.lit(0).cast("bigint"))
        return log.groupBy("target", "name").agg(
            F.max_by("role", F.struct("number", "seq")).alias("role"),
            F.max_by("at", "number").alias("since"), F.max("number").alias("number"),
        )

    def current(self, target: str = "*") -> DataFrame:
        """(target, name, role, since) of everything that exists."""
        return self._newest(target).filter(F.col("role") != DROPPED).drop("number")

    def state(self, target: str) -> str:
        found = registry.state(self.current(target)).first()
        return "missing" if found is None else found["state"]

    def _read(self, target: str) -> tuple[int, list[tuple[str, str, str]]]:
        """The number of the newest entry and (name, role, since) of what exists, oldest first."""
        there = F.when(F.col("role") != DROPPED, F.struct("number", "name", "role", "since"))
        found = self._newest(target).agg(F.max("number").alias("head"), F.collect_list(there).alias("there")).first()
        return found["head"] or 0, [(r["name"], r["role"], r["since"]) for r in sorted(found["there"])]

    def _roles(self, target: str) -> Roles:
        """Names by role, the newest last: one row per version of a single target."""
        return _by_role(self._read(target)[1])

    def published(self, target: str) -> str:
        """The name of the published version, ``NOBODY`` if there is none."""
        return self._roles(target).get("target", [NOBODY])[-1]

    def _change(self, target: str, decide: Callable[[Roles, Mapping[str, str]], Changes]) -> Changes:
        """Append what ``decide`` makes of the log, as one entry right behind the last one it has seen.

        ``decide`` gets names by role and the time since when each has it. It is asked again whenever another
        run has written in between, and may raise; no change writes nothing.
        """
        taken = 0
        while True:
            head, there = self._read(target)
            if taken > head:
                raise RuntimeError(f'entry {taken} of the log of "{target}" is there and cannot be read')
            changes = decide(_by_role(there), {name: since for name, _, since in there})
            if not changes:
                return changes
            at = _stamp(_now())
            lines = [
                json.dumps({"target": target, "name": name, "role": role, "at": at, "seq": i})
                for i, (name, role) in enumerate(changes)
            ]
            # One file: it is there or it is not.
            if create_new(self.spark, f"{self._log(target)}/{head + 1:020d}.json", "\n".join(lines) + "\n"):
                return changes
            taken = head + 1

    def _append(self, target: str, entries: Changes) -> None:
        self._change(target, lambda roles, since: entries)

    def stage(self, target: str, frames: Mapping[str, DataFrame], workers: int = 4) -> str:
        """Write a version nobody reads yet and give its name. Tables are written side by side."""
        name = staging_name()
        self._append(target, [(name, "staging")])

        def write(item: tuple[str, DataFrame]) -> None:
            table, df = item
            df.write.mode("error").parquet(self.table_path(target, name, table))

        try:
            with ThreadPoolExecutor(max_workers=workers) as pool:
                list(pool.map(inheritable_thread_target(self.spark)(write), frames.items()))
        except Exception:
            self.discard(target, name)
            raise
        return name

    def discard(self, target: str, name: str) -> None:
        """Give up a staged version; the target is as it was."""
        self._clear(target, self._change(target, lambda roles, since: [(name, DROPPED)]))

    def _clear(self, target: str, changes: Changes) -> list[str]:
        """The log says that versions are gone before their files go, so no reader is sent to half of one."""
        gone = [name for name, role in changes if role == DROPPED]
        for name in gone:
            remove(self.spark, self.path(target, name))
        return gone

    def read_version(self, target: str, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.table_path(target, name, table))

    def next_values(self, target: str) -> DataFrame:
        """(schema, name, next_value) of the published version's sequences."""
        return self.read(target, NEXT_VALUES)

    def sketches(self, target: str, table: str) -> DataFrame:
        """Column sketches of one table in all versions that have them, with the version's ``name`` and ``role``.

        Sketches of several names can be merged; a version that was restored without a profile has none.
        """
        found = [
            self.spark.read.parquet(place).withColumns({"name": F.lit(name), "role": F.lit(role)})
            for role, names in self._roles(target).items() for name in names
            if path_exists(self.spark, place := f"{self.path(target, name)}/{SKETCHES}/{path_part(table)}")
        ]
        if not found:
            raise LookupError(f'no version of "{target}" has sketches of "{table}"')
        return union_all(found)

    def read(self, target: str, table: str) -> DataFrame:
        """A table of the published version."""
        names = self._roles(target).get("target")
        if not names:
            raise LookupError(f'nothing is published as "{target}"')
        return self.read_version(target, names[-1], table)

    def publish(
        self, target: str, name: str, reports: Sequence[DataFrame] = (), workers: int = 4,
        replaces: str | None = None,
    ) -> None:
        """Make a staged version current, unless a check found an error.

        ``replaces`` is what was ``published`` when the run began. If something else is by now, another run
        was first; this one is refused and its version dropped, as it may hold older data.

        Every report is a job of its own, several at a time, so that many tables do not
        become one plan. On refusal the staged version is dropped and the target is as
        it was. The version replaced becomes the newest backup and stays until a later
        run expires it.
        """

        def errors(report: DataFrame) -> list[str]:
            bad = report.filter((F.col("severity") == ERROR) & (F.col("violations") > 0))
            found = bad.groupBy("table", "check", "subject").agg(F.sum("violations").alias("n"))
            # At most one row per declared check.
            return [f"{r['table']}: {r['check']} {r['subject']}: {r['n']}" for r in found.collect()]

        with ThreadPoolExecutor(max_workers=workers) as pool:
            found = pool.map(inheritable_thread_target(self.spark)(errors), reports)
            lines = sorted(line for some in found for line in some)
        if lines:
            self.discard(target, name)
            raise PublishRefused(lines)

        def swap(roles: Roles, since: Mapping[str, str]) -> Changes:
            if name not in roles.get("staging", []):
                raise LookupError(f'"{name}" is not a staged version of "{target}"')
            old = roles.get("target", [])
            if replaces is not None and (old or [NOBODY])[-1] != replaces:
                raise PublishConflict(f'"{target}" was published as {old[-1] if old else "nothing"} meanwhile')
            return [*((o, "backup") for o in old), (name, "target")]

        try:
            self._change(target, swap)
        except PublishConflict:
            self.discard(target, name)
            raise

    def expire(self, target: str, keep: int = 1) -> list[str]:
        """Drop backups beyond the newest ``keep``, and remove their files.

        A run does this before it stages anything, so what it replaces is there to fall back to.
        """

        def beyond(roles: Roles, since: Mapping[str, str]) -> Changes:
            backups = roles.get("backup", [])
            return [(n, DROPPED) for n in backups[: max(0, len(backups) - max(0, keep))]]

        return self._clear(target, self._change(target, beyond))

    def recover(self, target: str, abandoned_after: timedelta | None = None) -> str:
        """Put a target back after a run died; never continues what the run was doing.

        Gives the state that was found. What is staged is dropped; with ``abandoned_after`` only what
        was staged that long ago, as younger versions may belong to a run that is still at work.
        """
        before = None if abandoned_after is None else _stamp(_now() - abandoned_after)
        found = "missing"

        def back(roles: Roles, since: Mapping[str, str]) -> Changes:
            nonlocal found
            staging = [n for n in roles.get("staging", []) if before is None or since[n] <= before]
            found = "idle" if roles.get("target") else "crashed_mid_swap" if roles.get("backup") else "missing"
            if found == "idle" and staging:
                found = "orphaned_staging"
            if found == "missing":
                return []
            again = [(roles["backup"][-1], "target")] if found == "crashed_mid_swap" else []
            return [*again, *((n, DROPPED) for n in staging)]

        changes = self._change(target, back)
        if found == "missing":
            raise LookupError(f'"{target}" has neither a published version nor a backup; left as found')
        self._clear(target, changes)
        return found


def _by_role(there: Sequence[tuple[str, str, str]]) -> Roles:
    out: Roles = {}
    for name, role, _ in there:
        out.setdefault(role, []).append(name)
    return out
