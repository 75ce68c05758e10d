"""Where the parts of a snapshot are."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote

_TIMESTAMP = re.compile(r"^\d{8}T\d{6}Z$")


def path_part(name: str) -> str:
    """A name as one part of a path: whatever a path or a pattern gives a meaning is percent-encoded."""
    return quote(name, safe="") if name.strip(".") else name.replace(".", "%2E")


@dataclass(frozen=True)
class Layout:
    root: str
    database: str
    ts: str

    def __post_init__(self) -> None:
        if not _TIMESTAMP.match(self.ts):
            raise ValueError(f'snapshot name "{self.ts}" is not a timestamp like 20240131T235959Z')

    @property
    def folder(self) -> str:
        return f"{self.root.rstrip('/')}/{path_part(self.database)}/{self.ts}"

    @property
    def manifest(self) -> str:
        return f"{self.folder}/manifest.json"

    @property
    def digests(self) -> str:
        return f"{self.folder}/digests"

    def data(self, qualified: str) -> str:
        """The schema is part of the name: two schemas can hold tables of one name."""
        return f"{self.folder}/data/{path_part(qualified)}"

    def table_digests(self, qualified: str) -> str:
        return f"{self.digests}/{path_part(qualified)}"

    def relative(self, place: str | None) -> str | None:
        """A place below the snapshot's folder, as the manifest holds it: the folder may move."""
        return place.removeprefix(f"{self.folder}/") if place else place

    def resolve(self, place: str | None) -> str | None:
        return f"{self.folder}/{place}" if place and not place.startswith("/") and "://" not in place else place
