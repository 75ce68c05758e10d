"""Token ids of whole texts by a public tokenizer file, word by word where that gives the same ids.

Both byte-level files cut a text into pieces that never cross a single space between two other
characters, and encode each piece by itself. So a piece is encoded once, by the library's model, and its ids are
remembered as bytes; a text is the join of its pieces. Parts outside Latin-1 or with a special string
in them go through the library's whole ``encode``. A file of any other build is used on whole texts only.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*").fullmatch
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_CUT, _SPLIT = _BETWEEN.search, _BETWEEN.split
# The pieces that the two tokenizer files name, for Latin-1.
_PIECES = {
    "spaced": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+",
    "bare": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+",
}
KNOWN_PIECES, KNOWN_BARE = 1_000_000, 300_000  # 200 bytes each, in every Python worker; lower-cased pieces are fewer
LONGEST_KNOWN, STRETCH = 48, 1 << 20


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as the next letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in prints}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Known(dict):
    """What ``make`` gives for a string; emptied when full, and long strings are not kept."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_KNOWN:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids, equal to the library's for the whole text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(" " in s or s != s.strip() for s in self.special) or any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            self.kind = None
        if self.kind:
            self.model = self.library.model
            self.letters = _byte_letters()
            self.space = self.letters[32]  # the only printing ASCII character that is not written as itself
            self.ascii = {b: c for b, c in self.letters.items() if b < 128 and chr(b) != c}
            self.find = re.compile(_PIECES[self.kind]).findall
            self.pieces = _Known(self._piece, KNOWN_PIECES if self.kind == "spaced" else min(KNOWN_PIECES, KNOWN_BARE))

    @staticmethod
    def _kind(spec: dict) -> str | None:
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        if spec["post_processor"] or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return None
        if norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "spaced"
        steps = [n["type"] for n in norm.get("normalizers", [])] if norm else []
        cut = pre.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in cut] == ["Split", "ByteLevel"] \
                and cut[0]["invert"] and cut[0]["behavior"] == "Removed" \
                and cut[0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return "bare"
        return None

    def _whole(self, text: str) -> bytes:
        return _little(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            written = piece.replace(" ", self.space) if piece.isprintable() else piece.translate(self.ascii)
        else:
            written = "".join(map(self.letters.__getitem__, piece.encode()))
        return _little([t.id for t in self.model.tokenize(written)])

    def _stretch(self, text: str) -> bytes:
        if _SIMPLE(text) and not any(s in text for s in self.special):
            return b"".join(map(self.pieces.__getitem__, self.find(text.lower() if self.kind == "bare" else text)))
        first, *rest = _SPLIT(text)
        lead = " " if self.kind == "spaced" else ""
        return self._part(first) + b"".join(self._part(lead + part) for part in rest)

    def _part(self, part: str) -> bytes:
        if _SIMPLE(part) and not any(s in part for s in self.special):
            return b"".join(map(self.pieces.__getitem__, self.find(part.lower() if self.kind == "bare" else part)))
        return self._whole(part)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind is None:
            return self._whole(text)
        out, start = [], 0
        while len(text) - start > STRETCH and (cut := _CUT(text, start + STRETCH)):
            out.append(self._stretch(text[start : cut.start()]))
            start = cut.start()  # the next stretch starts with its space, as its first piece does
        return b"".join([*out, self._stretch(text[start:] if start else text)])


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, so what it remembers lasts from task to task."""
    return Encoder(path)


def with_output(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` over record batches; ``make`` turns one bounded batch into a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from .common import slices

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, type=field.type) for column, field in zip(make(batch), arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)
